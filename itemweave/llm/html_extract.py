"""Main text of pages by a site style tree.

Pages are cut into blocks of text, each with its style path (tags and classes from the body down). Elements whose tag, role,
class or id says menu, header, footer, sidebar, notice, advert, form, script, style or reader comments go first. All blocks
that remain, of all pages, are merged by host into a style tree, and the tree decides on every page:

* a content (a text under a path) on c of the host's m pages has the importance 1 - log_m(c): 0 if it is on every page;
* an element has the presentation importance H, the entropy, to the base m, of the sequences of children it has on the
  host's pages, and the composite importance (1 - g^l) H + g^l C, with l such sequences, g = 0.9, and C the mean
  importance of the contents below it;
* an element is noise if its importance and that of all elements below it is low, as an element of few shapes may well hold an article.

Contents and noisy elements of an importance below ``threshold`` go. What an article or main element holds is a part of the tree of its
own, with paths that begin with INSIDE and the stricter threshold MAIN_THRESHOLD: a passage that many articles share is still text of
each, one that nearly all pages of a host have is part of the site. Where such elements hold any text, the page's text is what the
tree leaves of it (all of it, if the tree leaves nothing), else what it leaves of all blocks. Pages of equal blocks count once
for each host, so copies of a page do not make its article look like a part of the site. m is the number of
those pages and UNSEEN more that are taken to share nothing, so that little is concluded from few pages.

A class or id counts as a whole, or if each of its hyphenated parts is a listed name or a word like site, box or list: "cookie-banner"
and "site-footer" go, "no-sidebar", "related-work" and "entry-header" stay. Elements inside a line go by their tag only.

A content below the threshold is on at least m^(1 - threshold) of m pages, so a host has few of them, however many pages
it has; they go back to its pages as one list. Counts are summed by (host, path, content), so a host with a third of all
pages is spread over tasks. Pages are parsed once; texts stay where they are, and only hashes go into the tree.

Defined cases: a NULL or empty page has an empty text; a NULL url is a host of its own; a host whose blocks are all of low
importance keeps them; equal page_ids are rows of their own; an empty table gives an empty result; other columns are not read; pages
are read whole, in time linear in their length. An element that more than DEPTH others hold has the path of the last of them.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch, small

THRESHOLD, MAIN_THRESHOLD, ATTENUATION, DEPTH, UNSEEN = 0.2, 0.05, 0.9, 64, 8
#: What the paths of blocks and elements inside an article or main element begin with.
INSIDE = "!"

# Element names of HTML, by what they mean here.
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | set("head nav header footer aside form menu template button select option svg canvas object audio video dialog".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
             "strike strong sub sup time tt u var wbr img".split())
MAIN = {"article", "main"}
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners "
            "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social "
            "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments "
            "commentlist respond disqus discussion replies related recommended widget widgets toolbar pagination pager login signup".split())
PARTS = set("site top bottom left right box block bar list area wrapper container slot links buttons item items policy inner".split())
COMMENTS = set("comment comments commentlist reply replies discussion".split())

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_PART = re.compile(r"[-_]+")


def _named(found: dict[str, str], names: set[str]) -> bool:
    """Whether a class or the id is one of ``names`` or made up of them and of general words."""
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p for p in _PART.split(token) if p]
        if token in names or any(p in names for p in parts) and all(p in names or p in PARTS for p in parts):
            return True
    return False


class Page:
    """Blocks of one page: (path, text, inside main), and the children of each element by path."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, str, bool]] = []
        self.children: dict[str, list[str]] = {}
        # Open elements: name, path, dropped, inside main, place of the nearest element that is a block, number of blocks around.
        self.open: list[tuple[str, str, bool, bool, int, int]] = [("", "", False, False, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        self._read(html or "")
        self._end_block()
        self.has_main = any(inside for *_, inside in self.blocks)

    def _end_block(self) -> None:
        if self.text:
            text = " ".join(references.unescape("".join(self.text)).split())
            self.text = []
            if text:
                _, path, _, inside, _, _ = self.open[self.open[-1][4]]
                self.blocks.append((path, text, inside))

    def _push(self, name: str, attributes: str) -> None:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        _, path, dropped, inside, block, depth = self.open[-1]
        above = self.open[block][1]
        root = name in ("html", "body") or name in MAIN or found.get("role") == "main"
        drop = dropped or name in DROPPED
        if not drop and name not in INLINE:
            drop = found.get("role") in ROLES or name not in ("html", "body") and _named(found, COMMENTS if root else NAMES)
        main = inside or (name in MAIN or found.get("role") == "main") and not drop
        if name not in INLINE:
            block, depth = len(self.open), depth + 1
            label = name + "".join(f".{c}" for c in found.get("class", "").replace("/", " ").split()[:2])
            if depth <= DEPTH:
                path = f"{above}/{label}" if name not in ("html", "body") else ""
            if not drop:
                self.children.setdefault(INSIDE + above if inside else above, []).append(label)
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, path, drop, main, block, depth))

    def _pop(self, depth: int) -> None:
        for name, *_ in self.open[depth:]:
            self.places[name].pop()
        del self.open[depth:]

    def _start(self, name: str, attributes: str, closed: bool) -> None:
        if name not in INLINE:
            self._end_block()
            if name not in VOID:
                block = self.open[-1][4]
                other = self.open[block][0]
                if block and (other in CLOSES_ITSELF.get(name, ()) or other == "p" or other == "head" and name not in DROPPED):
                    self._pop(block)
        if name not in VOID and not closed:
            self._push(name, attributes)

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._end_block()
        places = self.places.get(name)
        # The end of an element inside a line does not close the block around it.
        if places and (name not in INLINE or places[-1] > self.open[-1][4]):
            self._pop(places[-1])

    def _read(self, html: str) -> None:
        at, end, quoted = 0, len(html), True
        while at < end:
            m = _TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and not self.open[-1][2]:
                self.text.append(html[at:stop])
            if not m:
                break
            if m[1]:
                close = html.find("-->", m.end())
                at = end if close < 0 else close + 3
                continue
            rest = _REST.match(html, m.end()) if quoted and m[4] else None
            if rest:
                at = rest.end()
            else:
                # A quote is left open: from here on the next > ends a tag.
                quoted = quoted and not m[4]
                close = html.find(">", m.end())
                at = end if close < 0 else close + 1
            if not m[4]:
                continue
            name, attributes = m[4].lower(), html[m.end():at - 1]
            if m[3]:
                self._end(name)
                continue
            self._start(name, attributes, attributes.endswith("/") and name in ("svg", "path"))
            if name in RAW:
                close = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(html, at)
                at = close.start() if close else end


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return (m[1] if m else "").rpartition("@")[2].lower()


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def _above(path: str) -> list[str]:
    """The path and all paths above it, but not the body."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts), 1, -1)]


#: Kinds of rows of the style tree.
PAGES, CONTENT, ELEMENT = -1, 0, 1
_SCAN = ("host string, digest long, page_id long, url string, text string, blocks array<struct<path: string, feature: long, size: int>>, "
         "elements array<struct<path: string, feature: long>>")
_BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("feature", pa.int64()), ("size", pa.int32())]))
_ELEMENTS = pa.list_(pa.struct([("path", pa.string()), ("feature", pa.int64())]))


def _scan(batches):
    """Each page with the text that it has if the tree finds no noise in it, and what goes into the tree: all blocks by path and hash, with
    their length where they are part of that text (else -1), and the hash of each element's children."""
    for batch in batches:
        rows = []
        for pid, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            page = Page(html.as_py())
            texts, blocks = [], []
            for path, text, inside in page.blocks:
                chosen = inside or not page.has_main
                if chosen:
                    texts.append(text)
                blocks.append((INSIDE + path if inside else path, _hash(text), len(text) if chosen else -1))
            elements = [(path, _hash(*labels)) for path, labels in page.children.items() if path not in ("", INSIDE)]
            digest = _hash(*(x for path, feature, _ in blocks for x in (path, str(feature))))
            rows.append((host_of(url.as_py()), digest, pid.as_py(), url.as_py(), " ".join(texts),
                         [dict(zip(("path", "feature", "size"), b, strict=True)) for b in blocks],
                         [dict(zip(("path", "feature"), e, strict=True)) for e in elements]))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _BLOCKS, _ELEMENTS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["host", "digest", "page_id", "url", "text", "blocks", "elements"])


def _extract(batches):
    """The text of pages on hosts with noise: the blocks that are neither noise nor below noise."""
    for batch in batches:
        ids, urls, whole, blocks, noise = (batch.column(i) for i in range(5))
        texts = []
        for text, page, low in zip(whole, blocks, noise, strict=True):
            text, at, kept, gone, inside = text.as_py(), 0, [], set(low.as_py() or ()), False
            for block in page.as_py():
                path, size = block["path"], block["size"]
                if size < 0:
                    continue
                inside = path.startswith(INSIDE)
                if _hash(path, str(block["feature"])) not in gone and not any(_hash(p) in gone for p in _above(path)):
                    kept.append(text[at:at + size])
                at += size + 1
            # An article is never dropped as a whole.
            texts.append(" ".join(kept) if kept or not inside else text)
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _hashed(batches):
    """Hashes of (path, content) or of a path, as _extract() looks them up."""
    for batch in batches:
        values = [_hash(p, str(f)) if k == CONTENT else _hash(p)
                  for p, k, f in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["host", "noise"])


def _limit(threshold: float) -> Column:
    """The threshold that holds for a path."""
    return F.when(F.startswith("path", F.lit(INSIDE)), F.lit(min(threshold, MAIN_THRESHOLD))).otherwise(F.lit(threshold))


def style_tree(scan: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(host, kind, path, feature, importance) of the elements and of contents below the threshold. The importance of an element is the
    largest of its own and of those below it; m is the host's different pages and UNSEEN more."""
    pages = (scan.where(F.size("blocks") > 0).groupBy("host", "digest")
             .agg(F.first("blocks").alias("blocks"), F.first("elements").alias("elements")))

    def row(kind: int, path: Column, feature: Column) -> Column:
        return F.struct(F.lit(kind).cast("byte").alias("kind"), path.alias("path"), feature.alias("feature"))

    none = F.lit(0).cast("long")
    contents = F.array_distinct(F.transform("blocks", lambda b: row(CONTENT, b["path"], b["feature"])))
    elements = F.transform("elements", lambda e: row(ELEMENT, e["path"], e["feature"]))
    rows = pages.select("host", F.explode(F.concat(F.array(row(PAGES, F.lit(""), none)), contents, elements)).alias("s")).select("host", "s.*")
    styles = scratch.save(rows.groupBy("host", "kind", "path", "feature").agg(F.count("*").alias("n")), "styles")
    hosts = small(styles.where(F.col("kind") == PAGES).select("host", (F.col("n") + UNSEEN).alias("m")), 100_000)
    known = styles.where(F.col("kind") >= CONTENT).join(hosts, "host")
    contents = known.where(F.col("kind") == CONTENT).withColumn("importance", 1 - F.log("n") / F.log("m"))
    # Every element above a content, by the depth of its path.
    above = F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    below = (contents.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("importance")).alias("s"))
             .select("host", "n", "s", F.explode_outer(above).alias("path"))
             .groupBy("host", "path").agg((F.sum("s") / F.sum("n")).alias("below")))
    of = known.where(F.col("kind") == ELEMENT)
    total = of.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.count("*").alias("l"),
                                           F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.first("m").alias("m"))
    entropy = (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("m")
    elements = below.join(total, ["host", "path"], "left").withColumn(
        "importance", F.coalesce((1 - F.pow(F.lit(ATTENUATION), "l")) * entropy + F.pow(F.lit(ATTENUATION), "l") * F.col("below"), "below"))
    best = elements.select("host", "importance", F.explode(above).alias("path")).groupBy("host", "path").agg(F.max("importance").alias("importance"))
    return contents.where(F.col("importance") < _limit(threshold)).select("host", "kind", "path", "feature", "importance").union(
        best.select("host", F.lit(ELEMENT).cast("byte"), "path", none, "importance"))


def main_text(pages: DataFrame, threshold: float = THRESHOLD, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row."""
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    scan = scratch.save(rows.mapInArrow(_scan, _SCAN), "scan", batch=500)
    tree = scratch.save(style_tree(scan, scratch, threshold), "tree")
    alive = tree.where(F.col("kind") == ELEMENT).groupBy("host").agg(F.max("importance").alias("best")).where(F.col("best") >= threshold).select("host")
    low = tree.where(F.col("importance") < _limit(threshold)).join(small(alive, 100_000), "host", "left_semi")
    noise = scratch.save(low.select("host", "kind", "path", "feature").mapInArrow(_hashed, "host string, noise long")
                         .groupBy("host").agg(F.collect_set("noise").alias("noise")), "noise")
    found = scan.join(small(noise, 20_000), "host", "left")
    rest = found.where("noise IS NOT NULL").select("page_id", "url", "text", "blocks", "noise")
    rest = scratch.save(rest.mapInArrow(_extract, "page_id long, url string, text string"), "rest", batch=500)
    scratch.drop("styles", "tree")
    return (found.where("noise IS NULL").select("page_id", "url", "text").union(rest)
            .withColumn("n_chars", F.length("text").cast("long")))
