"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemweave.llm.common import table
from itemweave.llm.conversation_repair import repaired_digests
from itemweave.llm.decontam import UNITS, leaks
from itemweave.llm.hard_negatives import hard_negatives
from itemweave.llm.html_extract import main_text
from itemweave.llm.jaccard import jaccard_components
from itemweave.llm.line_dedup import line_dedup
from itemweave.llm.lm_score import lm_scores
from itemweave.llm.packing import pack
from itemweave.llm.quality import quality_scores
from itemweave.llm.substring_dedup import repeated_words
from itemweave.llm.suffix_dedup import repeated_bytes
from itemweave.llm.url_filter import evaluate, host, path
from itemweave.llm.warc import fetch, find, write_archives, write_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


@query("op7_quality")
def op7_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"))


@query("op10_jaccard")
def op10_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


_OP1 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d),
l AS (SELECT doc_id, pos, ls[pos] AS line FROM p WHERE regexp_matches(ls[pos], '[^\x20\x09-\x0D]')),
x AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS o FROM l GROUP BY line),
h AS (SELECT *, unnest(list_distinct([(n // 2)::BIGINT, ((n - 1) // 2)::BIGINT])) AS h FROM x WHERE n >= 20),
k AS (SELECT *, 'p' AS side, left(line, h) AS k FROM h UNION ALL SELECT *, 's', right(line, h) FROM h),
c AS (SELECT DISTINCT a.line AS x, a.n AS n, b.line AS y, b.n AS m FROM k a JOIN k b
      ON a.side = b.side AND a.h = b.h AND a.k = b.k AND b.o < a.o AND abs(a.n - b.n) <= 1),
i AS (SELECT *, coalesce(list_min(list_filter(range(1, least(n, m) + 1), lambda j: x[j] <> y[j])), least(n, m) + 1) AS i FROM c),
r AS (SELECT DISTINCT x FROM i WHERE (n = m AND substr(x, i + 1) = substr(y, i + 1))
      OR (n = m + 1 AND substr(x, i + 1) = substr(y, i)) OR (m = n + 1 AND substr(x, i) = substr(y, i + 1))),
s AS (SELECT l.doc_id, l.pos, l.line FROM l JOIN x ON l.line = x.line AND (l.doc_id, l.pos) = x.o
      WHERE l.line NOT IN (SELECT x FROM r)),
t AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(n.n, 0) - coalesce(t.n, 0) AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN t ON t.doc_id = documents.doc_id
"""


@query("op1_line_dedup", _OP1)
def op1_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _canonical_sql(name: str, key: str) -> str:
    """CTEs for the windows of a table: (key, place, h as the text of the window, slots, literals)."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    number = "regexp_matches({w}, '^[0-9]+([-/%][0-9]*)*$')"
    return f"""
{name}_m AS (SELECT DISTINCT {key}, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '.!?,;:"()[]{{}}“”„«»', repeat(chr(1), 3)), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS m FROM {name}),
{name}_r AS (SELECT {key}, m, list_transform(m, lambda w: replace(w, chr(1), '')) AS r FROM {name}_m),
{name}_c AS (SELECT {key}, r, list_transform(r, lambda w, i: CASE
    WHEN {number.format(w="w")} THEN '<n>'
    WHEN i > 1 AND {number.format(w="r[i - 1]")} AND list_contains([{units}], lower(w)) THEN '<u>'
    WHEN lower(w) <> w AND i > 1 AND NOT ends_with(m[i - 1], chr(1)) THEN '<a>'
    ELSE lower(w) END) AS c FROM {name}_r),
{name}_p AS (SELECT {key}, unnest(list_transform(range(1, len(c) - 6), lambda p: {{'place': p,
    'h': array_to_string(c[p:p + 7], ' '),
    'slots': list_transform(list_filter(range(p, p + 8), lambda k: c[k] IN ('<n>', '<u>', '<a>')), lambda k: lower(r[k]))}})) AS w FROM {name}_c),
{name}_w AS (SELECT {key}, w.place AS place, w.h AS h, w.slots AS slots FROM {name}_p)"""


#: Literal windows: words without case and punctuation. A template's place among them skips words that are a full stop alone.
_LITERAL = """regexp_split_to_array(lower(translate(coalesce(text, ''), '.!?,;:"()[]{}“”„«»', '')), '[\\x20\\x09-\\x0D]+')"""

#: Of the values that a slot has in an alignment, that of most windows counts, of equals the least; windows with another go.
_OP8 = f"""
WITH {_canonical_sql("documents", "doc_id")}, {_canonical_sql("benchmark", "item_id")},
i AS (SELECT item_id, m, c, r, list_filter({_LITERAL}, lambda w: w <> '') AS l
    FROM (SELECT DISTINCT item_id, text FROM benchmark) JOIN benchmark_m USING (item_id) JOIN benchmark_c USING (item_id)),
i2 AS (SELECT item_id, l, m, list_filter(range(1, len(m) + 1), lambda k: m[k] <> chr(1)) AS p FROM i),
w AS (SELECT w.item_id, w.place, w.h, w.slots, len(w.slots) <= 4 AS typed, l, CASE WHEN len(p) = len(m) THEN w.place ELSE list_position(p, w.place) END AS lit
    FROM benchmark_w w JOIN i2 USING (item_id)),
t AS (SELECT *, CASE WHEN lit >= 1 AND lit + 7 <= len(l) THEN array_to_string(l[lit:lit + 7], ' ') END AS g FROM w),
n AS (SELECT item_id, bool_or(typed) AS templated, count(DISTINCT place) FILTER (typed) AS typed_n, count(DISTINCT place) FILTER (g IS NOT NULL) AS literal_n FROM t GROUP BY item_id),
known AS (SELECT item_id, CASE WHEN templated THEN typed_n ELSE literal_n END AS n_windows, place, CASE WHEN typed THEN h END AS h, slots, g
    FROM t JOIN n USING (item_id) WHERE typed OR (NOT templated AND g IS NOT NULL)),
met AS (SELECT DISTINCT d.doc_id, k.item_id, k.n_windows, k.place, d.place - k.place AS shift, k.slots AS a, d.slots AS b
    FROM documents_w d JOIN known k ON d.h = k.h),
v AS (SELECT DISTINCT doc_id, item_id, shift, place, unnest(list_zip(a, b)) AS v FROM met),
most AS (SELECT doc_id, item_id, shift, v[1] AS slot, v[2] AS val FROM v GROUP BY doc_id, item_id, shift, v[1], v[2]
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, shift, v[1] ORDER BY count(*) DESC, v[2]) = 1),
x AS (SELECT *, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE list_zip(a, b) END) AS v FROM met),
z AS (SELECT x.doc_id, x.item_id, x.n_windows, x.place, x.shift, x.a, x.b, bool_and(v IS NULL OR coalesce(v[2] = val, false)) AS fits
    FROM x LEFT JOIN most ON x.doc_id = most.doc_id AND x.item_id = most.item_id AND x.shift = most.shift AND v[1] = slot GROUP BY ALL),
f AS (SELECT doc_id, item_id, n_windows, shift, place, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE list_zip(a, b) END) AS v FROM z WHERE fits),
al AS (SELECT doc_id, item_id, n_windows, shift, list(DISTINCT place) AS places, count(DISTINCT v[1]) FILTER (v[1] <> v[2]) AS n_changed FROM f GROUP BY ALL),
dl AS (SELECT DISTINCT doc_id, list_filter({_LITERAL}, lambda w: w <> '') AS l FROM documents),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(l) - 6), lambda p: array_to_string(l[p:p + 7], ' '))) AS g FROM dl),
found AS (SELECT doc_id, item_id, n_windows, unnest(places) AS place, n_changed FROM al
    UNION ALL SELECT doc_id, item_id, n_windows, place, 0 FROM dg JOIN known USING (g))
SELECT doc_id, item_id, n_windows, count(DISTINCT place) AS n_matched, max(n_changed) AS n_changed
FROM found GROUP BY ALL HAVING 100 * count(DISTINCT place) >= 50 * n_windows
"""


@query("op8_decontamination", _OP8)
def op8_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_lm_scoring")
def op3_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents")).drop("n_bytes", "bits_per_byte")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    return repeated_bytes(table(spark, sf_dir, "documents"), length=50, texts=False)


@query("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    return repeated_words(table(spark, sf_dir, "documents"), window=35, texts=False)


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


#: The list: an event of user u, at its time, is about the pages with page_id mod 1000 = u mod 1000: their host, or for odd
#: users the first segment of their path on this host. Errors and purchases block, other events allow.
#: A page is fetched 40 minutes of its id after 2024-01-01, round the 30 days of the events.
_OP2 = r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    TIMESTAMP '2024-01-01' + to_seconds((page_id * 2400) % 2592000) AS fetched FROM pages),
e AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 OR path = '' THEN host ELSE host || '/' || split_part(path, '/', 2) END AS pattern, ts,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'block' ELSE 'allow' END AS action
    FROM events JOIN u ON user_id % 1000 = page_id % 1000 WHERE host <> ''),
f AS (SELECT pattern, ts, min(action) AS action FROM e GROUP BY ALL),
i AS (SELECT pattern, ts, action, lead(ts) OVER (PARTITION BY pattern ORDER BY ts) AS til FROM f),
l AS (SELECT page_id, host, path, fetched, string_split(host, '.') AS hs, string_split(path, '/') AS ps FROM u WHERE host <> ''),
a AS (SELECT page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, len(hs) + 1), lambda k: array_to_string(hs[k:], '.')),
    CASE WHEN path = '' THEN [] ELSE list_transform(range(2, len(ps) + 1), lambda k: host || array_to_string(ps[:k], '/')) END))) AS pattern FROM l),
m AS (SELECT page_id, max((length(a.pattern), a.pattern, ts, action)) AS b FROM a JOIN i ON a.pattern = i.pattern
    AND ts <= fetched AND (til IS NULL OR fetched < til) GROUP BY page_id)
SELECT u.page_id, url, b[2] AS pattern, epoch_us(b[3]) AS since_us, b[4] AS action, coalesce(b[4] <> 'block', true) AS kept
FROM u LEFT JOIN m USING (page_id)
"""


@query("op2_url_filters", _OP2)
def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seconds = F.lit(1704067200) + (F.col("page_id") * 2400) % 2592000
    captures = pages.withColumn("fetched", F.timestamp_seconds(seconds))
    about = pages.select((F.col("page_id") % 1000).alias("slot"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where("host <> ''")
    section = F.concat("host", F.lit("/"), F.get(F.split("path", "/"), 1))
    about = about.select("slot", F.col("host").alias("whole"), F.when(F.col("path") == "", F.col("host")).otherwise(section).alias("section")).distinct()
    events = table(spark, sf_dir, "events").select(
        "ts", (F.col("user_id") % 1000).alias("slot"), (F.col("user_id") % 2 == 0).alias("even"),
        F.when(F.col("event_type").isin("error", "purchase"), "block").otherwise("allow").alias("action"))
    entries = events.join(about, "slot").select(F.when(F.col("even"), F.col("whole")).otherwise(F.col("section")).alias("pattern"), "ts", "action")
    out = evaluate(captures, entries)
    return out.select("page_id", "url", "pattern", F.unix_micros(F.col("since").cast("timestamp")).alias("since_us"), "action",
                      F.coalesce(F.col("action") != "block", F.lit(True)).alias("kept"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    return repaired_digests(table(spark, sf_dir, "conversations"))


#: Every row with an id divisible by 50 is an anchor; every seventh label is one too high.
_OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", _OP12)
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256.0)


#: The digest is that of the whole payload, five bits a letter.
_OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, payload_bytes, min(page_id) AS first FROM p GROUP BY ALL)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (x, payload_bytes)
"""


@query("op13_warc", _OP13)
def op13_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    archive = write_index(write_archives(pages, least_bytes=0))
    records = fetch(archive, find(archive, pages), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
