"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its
lower-cased word 3-shingles. Two fingerprints that differ in at most d bits
agree on at least two of d + 2 blocks, so joining on every pair of blocks
finds every close pair; the Hamming distance is then verified. Equal
fingerprints are one node, so copies are never expanded into pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import stored
from .common import map_texts, table, utf8

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 2
#: Block buckets of up to this many fingerprints are compared pair by pair; larger ones go the exact way of `_through_neighbours`.
BUCKET_PAIRS = 32


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; no words give 0, fewer words than a shingle give one shingle of all."""
    words = data.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed long; an input column named as ``out`` is replaced. Null text counts as empty."""
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(x) for x in utf8(b.column(b.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], out])

    schema = base.drop("__text").schema.add(out, "long")
    return map_texts(base, run, schema)


def _block_masks(distance: int) -> list[int]:
    """Masks of every pair out of distance + 2 blocks of the 64 bits, as signed longs."""
    n = distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(a | b) for a, b in combinations(blocks, 2)]


def _through_neighbours(prints: DataFrame, distance: int) -> DataFrame:
    """Edges that connect exactly the prints at even distance or less, without comparing pairs.

    Two prints are within 2r bits iff some 64-bit value is within r bits of
    both, so each print is listed under itself and its neighbours within r
    bits; a value has a bounded number of such prints (65 for r = 1).
    """
    flips = [0]
    for r in range(1, distance // 2 + 1):
        flips += [sum(1 << i for i in at) for at in combinations(range(64), r)]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    near = prints.select("fp", F.explode(F.transform(F.array(*[F.lit(x) for x in signed]), lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))
    groups = near.groupBy("value").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("a")).where(F.size("fps") > 1)
    return groups.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()


def close_pairs(prints: DataFrame, distance: int = MAX_DISTANCE, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` whose components are those of "at most ``distance`` bits apart".

    Buckets of a pair of blocks with at most ``bucket_pairs`` prints are joined
    to themselves and verified; prints of larger buckets are linked through
    their neighbours, which is exact as well and linear. ``distance`` is even.
    """
    if distance % 2 or distance < 0:
        raise ValueError("distance must be even and not negative")
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    masks = F.array(*[F.struct(F.lit(i).alias("blocks"), F.lit(m).alias("mask")) for i, m in enumerate(_block_masks(distance))])
    keys = prints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.blocks").alias("blocks"), F.col("m.mask").bitwiseAND(F.col("fp")).alias("key"))
    sizes = keys.groupBy("blocks", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keys.join(sizes, ["blocks", "key"]), "blocks")
    small = members.where(F.col("n") <= bucket_pairs)
    left = small.select("blocks", "key", F.col("fp").alias("a"))
    right = small.select("blocks", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["blocks", "key"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    large = members.where(F.col("n") > bucket_pairs).select("fp").distinct()
    return pairs.unionAll(_through_neighbours(large, distance)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per input row.

    ``component_id`` is the smallest id reachable over links of at most
    ``distance`` bits, the document itself included. Null and empty texts have
    fingerprint 0 and are linked like any other; a null id counts for a
    component only if all its ids are null. Repeated rows stay repeated. Other
    columns are not read.
    """
    prints = stored(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), "text", "fp").drop("text"), "prints")
    by_print = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "by-print")
    comps = connected_components(close_pairs(by_print.select("fp"), distance))
    rooted = by_print.join(comps, by_print["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """The row with the smallest id of each component, all columns kept; of rows repeated whole, one. Null ids come last."""
    found = near_duplicates(docs, doc_id, text, distance)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("x"))
    keep = best.select(F.col("x.doc_id").alias("__keep_id"), F.col("x.fp").alias("__keep_fp"))
    own = with_fingerprint(docs, text, "__fp")
    same = own[doc_id].eqNullSafe(keep["__keep_id"]) & (own["__fp"] == keep["__keep_fp"])
    return own.join(keep, same, "left_semi").dropDuplicates([doc_id, "__fp"]).drop("__fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at two bits or fewer."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
