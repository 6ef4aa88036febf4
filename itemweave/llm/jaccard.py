"""Exact Jaccard join of word-shingle sets: size-banded tiles, bitmap signatures, sorted-array intersection.

1. Texts with equal shingle sets are one set (they link by definition).
2. Sets are banded by size: band i has the pairs whose smaller set has 2^i to 2^(i+1) - 1 shingles. Two linked sets of a
   band differ in at most k shingles, so when the shingles are dealt by hash into more than k parts, some part is the same in
   both. A tile is one such part with its content: sets meet only if a whole part agrees, and neither a passage that many
   texts share nor frequent shingles bring other texts together. A set leaves out its smallest parts as long as more than k
   larger ones remain (two linked sets then still agree on a part that both send). A set with no more filled parts than k
   (small or sparse ones) is also dealt by the prefix filter, its first n - ceil(t n) + 1 shingles in order of hash.
3. Each member of a tile is compared with one pivot; tiles take their pivots by one of PIVOTS orders. Links found so far
   are joined into components.
4. Tiles that still hold several components are cut into cells of at most about CELL x CELL members. Inside a
   cell all pairs of different components are compared by signature, in numpy. In a first round each member names its most
   promising partner; once those are settled and joined, all pairs that may link and are still apart are. Pairs within a
   component need no comparison, so a large group of copies costs a few comparisons a member.
5. A signature has one bit for each hashed shingle. Every bit that is set in x and not in y stands for a shingle of x
   that y lacks, so |x & y| <= |x| - popcount(x & ~y). Pairs that pass are settled on the sorted arrays.

No link is lost at any step, and no pair inside a component is needed. A shingle is a 64-bit hash and a set is known by a
64-bit hash of its sorted shingles. A task sends each set's parts once, so a tile gets at most a row for each set and task.

Defined cases: a NULL, empty or blank text has an empty set and links with nothing; a text with fewer words than a shingle
is one shingle; repeated rows and ties are one set and get the same component; a NULL doc_id links like any other, but a
component's id is its smallest doc_id that is not NULL; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm.blocks import starts, whole_groups
from itemweave.llm.common import Scratch, components, small
from itemweave.llm.shingles import mix, shingle_set

CELL, PIVOTS = 512, 3


def need(n, percent: int):
    """The least size of an intersection with a set of the same or a larger size, by the smaller bound n alone."""
    return (percent * n + 99) // 100


def _band(n: int) -> int:
    return n.bit_length() - 1


def most_different(n: int, m: int, percent: int) -> int:
    """The most shingles that are in one only of two linked sets of sizes n and m."""
    return (100 - percent) * (n + m) // (100 + percent)


def tile_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a sorted set, in its own band and in those below in which it can be the larger set."""
    n, out = len(s), []
    for i in range(_band(n) if n else -1, -1, -1):
        small_most = (2 << i) - 1
        most = 100 * small_most // percent
        if n > most:
            break
        k = most_different(small_most, most, percent)
        parts = np.uint64(k + 3 + k // 8)
        part = mix(s + np.uint64(i)) % parts
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(mix(s[order] ^ np.uint64(0x5851F42D4C957F2D)), first)
        keys = mix(content + mix(part[first] + np.uint64(1 + (i << 40))))
        enough = most_different(n, min(most, 100 * n // percent), percent) + 1
        if len(first) >= enough:
            size = np.diff(np.append(first, n))
            out.append(keys[size >= np.partition(size, len(size) - enough)[len(size) - enough]])
        else:
            out += [keys, mix(s[:n - need(n, percent) + 1] + np.uint64((i + 1) << 50))]
    return np.concatenate(out) if out else s


def signature(s: np.ndarray) -> bytes:
    """About four bits for each shingle of the largest set of the band; sets of two bands are compared after folding."""
    bits = 1 << max(6, _band(len(s)) + 3)
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(sig: np.ndarray, length: int) -> np.ndarray:
    """Halve rows of bytes until they have ``length``: the bit of a shingle modulo a smaller power of two."""
    while sig.shape[1] > length:
        half = sig.shape[1] // 2
        sig = sig[:, :half] | sig[:, half:]
    return sig


def linked(common, n, m, percent: int):
    """100 * |x & y| >= percent * |x | y|."""
    return 100 * common >= percent * (n + m - common)


def _scan(shingle: int, percent: int):
    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            cols = ([], [], [], [])
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), shingle)
                sid = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                keys = None if sid in sent else tile_keys(s, percent).view(np.int64)
                sent.add(sid)
                for c, v in zip(cols, (doc.as_py(), len(s), sid, keys), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.list_(pa.int64()))], names=["doc_id", "n", "sid", "keys"])
    return run


def _tiles(rows: pa.Table) -> pa.Table:
    """The distinct members of tiles with two or more; rows come sorted by (key, sid)."""
    key, sid = rows.column("key").to_numpy(), rows.column("sid").to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[new], sid[new]
    size = np.diff(np.append(starts(key), len(key)))
    c = np.repeat(size, size)
    key, sid, c = key[c > 1], sid[c > 1], c[c > 1]
    first = starts(key)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    order = np.lexsort((mix(sid.view(np.uint64) ^ (key.view(np.uint64) % np.uint64(PIVOTS))), group))
    return pa.table({"key": key, "sid": sid, "pivot": sid[order][first][group] if len(key) else sid, "c": c})


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())], names=["sid", "n", "shingles", "sig"])
    return run


def bit_bound(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most shingles that rows x and y of signatures can share."""
    only_x = np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64)
    only_y = np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - only_x, m - only_y)


def _may_link(percent: int):
    def run(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i) for i in range(4))
            keep = []
            for x, y, p, q in zip(batch.column(4), batch.column(5), n.to_pylist(), m.to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint8)[None, :], np.frombuffer(y.as_py(), np.uint8)[None, :]
                size = min(x.shape[1], y.shape[1])
                keep.append(bool(linked(bit_bound(fold(x, size), fold(y, size), p, q)[0], p, q, percent)))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _settle(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(linked(common, len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _settled(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) that link; signatures first unless the pairs have passed them already.

    Few pairs are sent to the sets and so find the first set without a shuffle; only sets in a pair are shuffled.
    """
    if not bounded:
        sig = sets.select("sid", "n", "sig")
        both = (pairs.join(sig.toDF("a", "n", "x"), "a").join(sig.toDF("b", "m", "y"), "b")
                .where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent))
        pairs = both.select("a", "b", "n", "m", "x", "y").mapInArrow(_may_link(percent), "a long, b long")
    pairs = scratch.save(pairs, f"{name}-pairs")
    whole = sets.select("sid", "shingles")
    heads = whole.toDF("a", "x").join(small(scratch.save(pairs.select("a").distinct(), f"{name}-heads")), "a", "left_semi")
    members = whole.toDF("b", "y").join(small(pairs), "b")
    out = members.join(heads, "a").select("a", "b", "x", "y").mapInArrow(_settle(percent), "a long, b long")
    return scratch.save(out.distinct(), name)


def _cells(percent: int, best: bool):
    """Rows of a cell come together; compare its left with its right members. best: one pair for each left member."""
    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        comp, sid, n = (rows.column(c).to_numpy() for c in ("comp", "sid", "n"))
        left = rows.column("is_left").to_numpy()
        sigs = [s.as_py() for s in rows.column("sig").combine_chunks()]
        size = min(map(len, sigs))
        sig = np.concatenate([fold(np.frombuffer(s, np.uint8)[None, :], size) for s in sigs]).view(np.uint64)
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = [], []
        for i in li:
            r = ri[(comp[ri] != comp[i]) & (np.minimum(n[ri], n[i]) * 100 >= np.maximum(n[ri], n[i]) * percent)]
            if len(r):
                bound = bit_bound(sig[i][None, :], sig[r], n[i], n[r])
                may = linked(bound, n[i], n[r], percent)
                r, bound = r[may], bound[may]
                if best and len(r):
                    r = r[[np.argmax(bound / (n[i] + n[r] - bound))]]
                a.append(np.full(len(r), sid[i]))
                b.append(sid[r])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        return None

    def run(batches):
        held, cell = [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held and tuple(ids[s]) != cell:
                    if (out := compare(pa.concat_tables(held))) is not None:
                        yield out
                    held = []
                cell = tuple(ids[s])
                held.append(t.slice(s, e - s))
        if held and (out := compare(pa.concat_tables(held))) is not None:
            yield out
    return run


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _open_cells(tiles: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The members of tiles that hold several components, dealt to cells (key, i, j); left ones are not of the pivot's."""
    rows = tiles.where("c > 2").join(small(labels), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    rows = scratch.save(rows, f"{name}-open")
    main = rows.where("sid = pivot").select("key", F.col("comp").alias("main"))
    apart = rows.join(main, "key").where("comp <> main").groupBy("key", "main").agg(F.count("*").alias("k"))
    rows = rows.join(apart, "key").where("sid <> pivot")
    nr, nl = F.ceil(F.col("c") / CELL).cast("int"), F.ceil(F.col("k") / CELL).cast("int")
    right = rows.select("key", "sid", "comp", F.pmod(F.xxhash64("sid"), nr).cast("int").alias("i"),
                        F.explode(F.sequence(F.lit(0), nl - 1)).alias("j"), F.lit(False).alias("is_left"))
    left = rows.where("comp <> main").select(
        "key", "sid", "comp", F.explode(F.sequence(F.lit(0), nr - 1)).alias("i"),
        F.pmod(F.xxhash64("sid", F.lit(1)), nl).cast("int").alias("j"), F.lit(True).alias("is_left"))
    return (left.union(right).join(sets.select("sid", "n", "sig"), "sid")
            .select("key", "i", "j", "is_left", "sid", "n", "comp", "sig"))


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = scratch.save(rows.mapInArrow(_scan(shingle, percent), "doc_id long, n long, sid long, keys array<long>"), "scanned")
    members = (scanned.select("sid", F.explode("keys").alias("key")).repartition(_parts(docs), "key").sortWithinPartitions("key", "sid"))
    tiles = scratch.save(members.mapInArrow(whole_groups(_tiles), "key long, sid long, pivot long, c long"), "tiles", batch=20_000)

    # The whole sets of tile members, from one document of each; documents without an id are all looked at.
    involved = scratch.save(tiles.select("sid").distinct(), "involved")
    ids = scratch.save(scanned.where("doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
                       .join(small(involved), "sid", "left_semi").select("doc_id"), "ids")
    schema = "sid long, n long, shingles binary, sig binary"
    known = rows.join(small(ids), "doc_id", "left_semi").select("text").mapInArrow(_sets(shingle), schema)
    unknown = rows.where("doc_id IS NULL").select("text").mapInArrow(_sets(shingle), schema).where("n > 0").dropDuplicates(["sid"])
    sets = scratch.save(known.union(unknown), "sets")
    scratch.drop("ids", "involved")
    stars = tiles.where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    edges = _settled(stars, sets, percent, scratch, "stars")
    for name, best in (("best", True), ("rest", False)):
        labels = scratch.save(components(scratch, edges, f"{name}-cc"), f"{name}-labels").toDF("sid", "comp")
        apart = _open_cells(tiles, labels, sets, scratch, name)
        pairs = apart.repartition(_parts(docs), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cells(percent, best), "a long, b long")
        edges = edges.union(_settled(pairs.distinct(), sets, percent, scratch, name, bounded=True)).distinct()
        scratch.drop(f"{name}-labels", f"{name}-open")
    scratch.drop("tiles")

    labels = scratch.save(components(scratch, edges, "all"), "components").toDF("sid", "comp")
    out = scanned.select("doc_id", "n", "sid").join(small(labels), "sid", "left")
    out = out.withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "sid")))
    lowest = out.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("lowest"))
    return out.join(lowest, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that link, over any path, to a row with a smaller doc_id."""
    scratch = Scratch(docs.sparkSession)
    found = jaccard_components(docs, shingle, percent, doc_id, text)
    extra = scratch.save(found.where("component_id < doc_id").select(F.col("doc_id").alias("__drop")).distinct(), "extra")
    return docs.join(small(extra), F.col(f"`{doc_id}`") == F.col("__drop"), "left_anti")
