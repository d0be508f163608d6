"""Exact and near duplicates by banded fingerprints, and their summaries.

Fingerprints are arrays of 64-bit words. Two that differ in at most T bits
agree on at least one of T + 1 bands, and on two of T + 2, so an equi-join on
pairs of bands with a Hamming check is complete and meets few others. Equal
fingerprints are one node. Groups come from links between one member of each
node; all pairs are only listed where a report asks for them. Buckets above a
cap make the join raise instead of leaving pairs out.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored
from .graph import connected_components
from .ranking import numbered

#: A larger bucket of distinct fingerprints makes detection raise: its pairs would grow with its square.
HARD_CAP = 50_000
#: Bits of a fingerprint, and n-grams whose bits are counted at a time.
PRINT_BITS, _GRAMS = 256, 1 << 16
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def content_hash(column: Column | str) -> Column:
    return F.md5(F.col(column) if isinstance(column, str) else column)


def fingerprint(text: str, width: int = 3) -> np.ndarray:
    """The majority bits of the SHA-256 of the distinct word n-grams, as four 64-bit words, the lowest first; no words give 0."""
    words = [w for w in _SPACE.split(text) if w]
    grams = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else set(words)
    ones, n, grams = np.zeros(PRINT_BITS, np.int64), len(grams), iter(grams)
    while part := b"".join(hashlib.sha256(g.encode()).digest() for _, g in zip(range(_GRAMS), grams, strict=False)):
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, PRINT_BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).view(">i8").astype(np.int64)[::-1]


def simhash(docs: DataFrame, id_: str = "id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, words): 256-bit SimHash of the distinct word n-grams of a lower-cased text; shorter texts use their words.

    Null and empty texts give 0. A text with a row of its own is never
    exploded: its n-grams are hashed in the batch that holds it.
    """
    base = docs.select(F.col(id_), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches):
        for b in batches:
            words = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], names=[id_, "words"])

    return base.mapInArrow(run, base.select(id_).schema.add("words", T.ArrayType(T.LongType())))


def hashed(files: DataFrame, id_: str = "id", content: str = "content", width: int = 3) -> DataFrame:
    """(id, failed, md5, words) of binary files: digest and fingerprint of their UTF-8 text; one that can't be read has nulls and never stops the job."""
    base = files.select(F.col(id_), F.col(content).cast("binary").alias("content"))

    def one(data: bytes | None):
        try:
            return False, hashlib.md5(data).hexdigest(), fingerprint(data.decode().lower(), width).tolist()
        except Exception:  # noqa: BLE001  whatever is wrong with a file, it is counted as failed
            return True, None, None

    def run(batches):
        for b in batches:
            found = [one(x.as_py()) for x in b.column(1)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_, "failed", "md5", "words"])

    return base.mapInArrow(run, base.select(id_).schema.add("failed", "boolean").add("md5", "string").add("words", T.ArrayType(T.LongType())))


def readable(hashes: DataFrame) -> DataFrame:
    return hashes.where("not failed").drop("failed")


def hash_counts(hashes: DataFrame) -> DataFrame:
    """One row: files that were hashed and files that failed."""
    return hashes.agg(F.count_if(~F.col("failed")).alias("n_hashed"), F.count_if("failed").alias("n_failed"))


def band_plan(n_bits: int, threshold: int) -> list[tuple[int, int]]:
    """(shift, width) of threshold + 1 bands over n_bits, as even as can be, the first ones wider, from the low bit."""
    bands = min(threshold + 1, n_bits)
    width, extra = divmod(n_bits, bands)
    out, at = [], 0
    for i in range(bands):
        w = width + (i < extra)
        out.append((at, w))
        at += w
    return out


def _bits(words: Column, shift: int, width: int) -> list[Column]:
    """Bits shift .. shift + width - 1 of an array of 64-bit words (low word first), as parts of one word each."""
    parts = []
    while width:
        word, at = divmod(shift, 64)
        take = min(width, 64 - at)
        part = F.shiftrightunsigned(F.get(words, F.lit(word)), at)
        parts.append(part.bitwiseAND(F.lit((1 << take) - 1)) if take < 64 else part)
        shift, width = shift + take, width - take
    return parts


def banded(prints: DataFrame, n_bits: int, threshold: int, id_: str = "id", words: str = "words") -> DataFrame:
    """(id, words, band, key): one row per band."""
    keys = F.array(*[F.concat_ws(".", *[x.cast("string") for x in _bits(F.col(words), s, w)]) for s, w in band_plan(n_bits, threshold)])
    return prints.select(F.col(id_).alias("id"), F.col(words).alias("words"), F.posexplode(keys).alias("band", "key"))


def _with_pair_keys(df: DataFrame, words: str, n_bits: int, threshold: int) -> DataFrame:
    """A row with ``key`` for every two of threshold + 2 bands; fingerprints within the threshold share a key."""
    bands = band_plan(n_bits, threshold + 1)
    if len(bands) < threshold + 2:
        raise ValueError("the threshold is too high for so few bits")
    two = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(len(bands)), 2)])
    rows = df.withColumn("__bands", F.array(*[F.xxhash64(*_bits(F.col(words), *x)) for x in bands])).withColumn("__p", F.explode(two))
    at = lambda k: F.get("__bands", F.col(f"__p.{k}"))
    return rows.withColumn("key", F.xxhash64("__p.i", "__p.j", at("i"), at("j"))).drop("__bands", "__p")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bucket_sizes(bands: DataFrame) -> DataFrame:
    return bands.groupBy("band", "key").agg(F.count("*").alias("m"))


def candidate_counts(bands: DataFrame) -> DataFrame:
    """One row: within-bucket comparisons (a pair once per band it shares) and distinct pairs' upper bound is left to the join."""
    m = F.col("m")
    return bucket_sizes(bands).agg(F.coalesce(F.sum(m * (m - 1) / 2), F.lit(0)).cast("long").alias("n_candidates"), F.max("m").alias("largest_bucket"))


def close_prints(distinct: DataFrame, n_bits: int, threshold: int, words: str = "words", cap: int = HARD_CAP) -> DataFrame:
    """(wa, wb, dist) for all different fingerprints within the threshold, wa < wb; raises if a bucket is over the cap."""
    keyed = _with_pair_keys(distinct.select(F.col(words).alias("w")), "w", n_bits, threshold)
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    largest = shared.agg(F.max("m")).first()[0] or 0
    if largest > cap:
        raise ValueError(f"a bucket has {largest} fingerprints, over the cap of {cap}: use more bits")
    members = stored(keyed.join(shared.select("key"), "key", "left_semi"), "members")  # the exploded side can't be broadcast
    left, right = (members.select("key", F.col("w").alias(n)) for n in ("wa", "wb"))
    dist = hamming(F.col("wa"), F.col("wb"))
    return left.join(right, "key").where("wa < wb").where(dist <= threshold).select("wa", "wb").distinct().withColumn("dist", dist)


def links(prints: DataFrame, n_bits: int, threshold: int, id_: str = "id", words: str = "words", cap: int = HARD_CAP) -> DataFrame:
    """(a, b): edges whose components are those of all pairs within the threshold.

    Each fingerprint's smallest id stands for it: its other ids and the close
    fingerprints' smallest ids are linked to that one, so copies grow rows in
    proportion.
    """
    first = stored(prints.groupBy(F.col(words).alias("w")).agg(F.min(id_).alias("first")), "first")
    copies = prints.select(F.col(id_).alias("b"), F.col(words).alias("w")).join(first, "w").where("b <> first").select(F.col("first").alias("a"), "b")
    close = close_prints(first, n_bits, threshold, "w", cap)
    ends = [first.select(F.col("w").alias(w), F.col("first").alias(n)) for w, n in (("wa", "a"), ("wb", "b"))]
    return copies.unionAll(close.join(ends[0], "wa").join(ends[1], "wb").select("a", "b"))


def near_pairs(prints: DataFrame, n_bits: int, threshold: int, id_: str = "id", words: str = "words", cap: int = HARD_CAP) -> DataFrame:
    """(a, b, dist) with a < b for all pairs within the threshold, those of copies included.

    A report: a group of n copies has n (n - 1) / 2 rows. Groups and counts
    come from `links` and `pair_counts`, which don't list them.
    """
    members = prints.select(F.col(id_).alias("id"), F.col(words).alias("words"))
    distinct = stored(members.select("words").distinct(), "distinct")
    a, b = (members.select(F.col("id").alias(x), F.col("words").alias(w)) for x, w in (("x", "wa"), ("y", "wb")))
    same = a.join(b, F.col("wa") == F.col("wb")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("dist"))
    close = close_prints(distinct, n_bits, threshold, cap=cap)
    other = close.join(a, "wa").join(b, "wb").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")
    return same.unionAll(other).distinct()


def pair_counts(prints: DataFrame, labels: DataFrame, n_bits: int, threshold: int, id_: str = "id", words: str = "words", label: str = "label") -> DataFrame:
    """One row: n_pairs within the threshold and n_conflicts among them (both labelled, 0 and 1), counted by fingerprint."""
    rows = prints.select(F.col(id_).alias("id"), F.col(words).alias("w")).join(labels.select(F.col(id_).alias("id"), F.col(label).alias("l")), "id", "left")
    own = stored(rows.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("l") == 0).alias("z"), F.count_if(F.col("l") == 1).alias("o")), "nodes")
    n, z, o = F.col("n"), F.col("z"), F.col("o")
    within = own.select((n * (n - 1) / 2).cast("long").alias("p"), (z * o).alias("c"))
    side = lambda k: own.select(F.col("w").alias(f"w{k}"), *[F.col(c).alias(c + k) for c in "nzo"])
    both = close_prints(own, n_bits, threshold, "w").join(side("a"), "wa").join(side("b"), "wb")
    between = both.select((F.col("na") * F.col("nb")).alias("p"), (F.col("za") * F.col("ob") + F.col("oa") * F.col("zb")).alias("c"))
    return within.unionAll(between).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_conflicts"))


def exact_groups(items: DataFrame, id_: str = "id", digest: str = "md5") -> DataFrame:
    """(md5, ids, n): sorted members of every content that occurs more than once (a report: a row holds a whole group; see star_edges)."""
    return items.groupBy(F.col(digest).alias("md5")).agg(F.array_sort(F.collect_list(id_)).alias("ids"), F.count("*").alias("n")).where("n > 1")


def star_edges(items: DataFrame, id_: str = "id", digest: str = "md5") -> DataFrame:
    """(a, b): the items of each content as a star on the smallest id; no group is gathered."""
    first = items.groupBy(digest).agg(F.min(id_).alias("a"))
    return items.join(first, digest).where(F.col(id_) != F.col("a")).select("a", F.col(id_).alias("b"))


def components(items: DataFrame, pairs: DataFrame, id_: str = "id") -> DataFrame:
    """(id, component): smallest reachable id for every item, single items included."""
    found = connected_components(pairs, "a", "b").withColumnRenamed("node", id_)
    return items.select(id_).distinct().join(found, id_, "left").withColumn("component", F.coalesce("component", id_))


def label_conflicts(pairs: DataFrame, labels: DataFrame, id_: str = "id", label: str = "label") -> DataFrame:
    """Add label_a, label_b and label_conflict, which is false if a label is missing."""
    a = labels.select(F.col(id_).alias("a"), F.col(label).alias("label_a"))
    b = labels.select(F.col(id_).alias("b"), F.col(label).alias("label_b"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.withColumn("label_conflict", F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(False)))


def numbered_components(comps: DataFrame, prefix: str = "dup_", width: int = 6, id_: str = "id") -> DataFrame:
    """(id, name): components numbered from 0 by size, largest first, then smallest member."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    names = numbered(sizes.withColumn("less", -F.col("size")), ["less", "component"], out="no")
    return comps.join(names, "component").select(id_, F.concat(F.lit(prefix), F.lpad(F.col("no").cast("string"), width, "0")).alias("name"))


def size_histogram(comps: DataFrame) -> DataFrame:
    """(bucket, n): components of size 1, 2, 3-5, 6-10, 11+."""
    size = F.col("size")
    bucket = F.when(size == 1, "1").when(size == 2, "2").when(size <= 5, "3-5").when(size <= 10, "6-10").otherwise("11+")
    return comps.groupBy("component").agg(F.count("*").alias("size")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def cross_set(pairs: DataFrame, side: DataFrame, id_: str = "id", flag: str = "in_test") -> DataFrame:
    """Pairs of which exactly one end is in the other set."""
    a = side.select(F.col(id_).alias("a"), F.col(flag).alias("side_a"))
    b = side.select(F.col(id_).alias("b"), F.col(flag).alias("side_b"))
    return pairs.join(a, "a").join(b, "b").where("side_a <> side_b")


def nearest_within(queries: DataFrame, rows: DataFrame, n_bits: int, limit: int, id_: str = "id", words: str = "words") -> DataFrame:
    """(id, kind, dist, nearest) of every query that has a row within the limit; queries and rows are two sets.

    Equal fingerprints are joined first (kind "exact"); the other queries meet
    fingerprints within ``limit`` bits on pairs of bands (kind "near"). Of
    equally near rows the smallest id counts. Every row is searched. Both sides
    of that join are shuffled: sizes are estimated without the rows that
    exploding makes, so one that is taken for small would fill the driver.
    """
    q = queries.select(F.col(id_).alias("id"), F.col(words).alias("wq"))
    r = stored(rows.groupBy(F.col(words).alias("wr")).agg(F.min(id_).alias("first")), "rows")
    exact = q.join(r, F.col("wq") == F.col("wr")).select("id", F.lit("exact").alias("kind"), F.lit(0).alias("dist"), F.col("first").alias("nearest"))
    other = q.join(r, F.col("wq") == F.col("wr"), "left_anti")
    keyed = lambda df, w: _with_pair_keys(df, w, n_bits, limit)
    met = keyed(other, "wq").hint("merge").join(keyed(r, "wr"), "key").withColumn("dist", hamming(F.col("wq"), F.col("wr"))).where(F.col("dist") <= limit)
    near = met.groupBy("id").agg(F.min(F.struct("dist", F.col("first").alias("nearest"))).alias("m"))
    return exact.unionAll(near.select("id", F.lit("near").alias("kind"), "m.dist", "m.nearest"))


def closest(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy("dist", "a", "b").limit(k)
