"""SimHash near-dedup of texts whose word shingles are similar, by pigeonhole blocks.

A text is the set of the 64-bit hashes of its lower-cased word 5-shingles. Its
shingles are dealt to classes by hash, and each class that has some gives a
block of the fingerprint: the bitwise majority of its shingles' hashes. A set
of x shingles and one with a Jaccard similarity of at least p / q to it differ
in at most s = x (q - p) / p shingles, which touch at most s classes. So of any
s + 1 blocks of the one, the other has at least one whole: whatever the one
order of all blocks is, the least block that both have is among the first
s + 1 of each, and a join on these finds every such pair. Blocks that are
frequent in a sample come last in the order, which changes no result.

The number of classes follows from a power of two above the larger size; a set
whose partner may be above the next power has blocks for both. Sets with too
few classes in use (their partners are the same) also have the first shingles
of the order as blocks.

Candidates are verified by the Hamming distance of parities (whether the number
of a set's hashes with given low bits is odd: 512 of them, and for larger sets
also as many as the power of two that holds them), which never exceeds the
shingles that two sets don't share, and then by the sets themselves. Equal
sets are one node. On the first blocks of each set, then in turns on all blocks
whose members are in several components, members are compared with one of them
and linked. Turns go on while the pairs that remain are many and a tenth less
members are in other components than before. Then those are compared with each
other, a pair once a block, the Hamming distance as a condition of the join. So
a large group of near copies is linked by stars as far as they reach, before
any block's pairs are listed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..storage import dropped, stored
from .common import bounded, map_texts, unused, utf8

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, SEED, LEAST = 5, 42, (4, 5)
#: Order of the blocks only: one text in this many is sampled, and the blocks of this many of them or more, at most so many, come last.
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 25, 1 << 17
#: Blocks of a set that are joined on first; members of a block that are compared pair by pair after one turn; turns over larger ones at least.
FIRST, SMALL, TURNS = 4, 8, 1
#: Pairs that are listed without further turns: so many, or so many a member of a block.
LISTED, LISTED_EACH = 100_000, 2
#: Classes whose majorities are taken at a time.
_CLASSES = 4096


def shingles(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; no words give none, fewer words than a shingle give one shingle of all."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def levels(n: int, least: tuple[int, int]) -> list[int]:
    """The power of two that holds n, and the next if a similar set may be that large."""
    p, q = least
    own = 1 << max(0, n - 1).bit_length()
    return [own] + [2 * own] * (n * q // p > own)


def _majorities(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bitwise majority of the hashes from each start up to the next, as 64-bit numbers."""
    ends = np.append(starts[1:], len(tokens))
    out = []
    for i in range(0, len(starts), _CLASSES):
        first, last = starts[i], ends[min(i + _CLASSES, len(starts)) - 1]
        bits = np.unpackbits(tokens[first:last].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[i : i + _CLASSES] - first, axis=0, dtype=np.int32)
        sizes = (ends - starts)[i : i + _CLASSES]
        out.append(np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


def _keyed(x: np.ndarray, level: int, kind: np.ndarray) -> np.ndarray:
    """One 64-bit key of a print within its level and class."""
    with np.errstate(over="ignore"):
        x = (x ^ (kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _late(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(keys), bool)
    return frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys


def blocks(tokens: np.ndarray, least: tuple[int, int] = LEAST, frequent: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:
    """Keys of which two similar sets that differ have one in common; tokens are sorted and distinct."""
    p, q = least
    n, out = len(tokens), [np.zeros(0, np.uint64)]
    for level in levels(n, least):
        if not (most := n * (q - p) // p):
            continue  # any other set is less similar
        count = level * (q - p) // p + 4 + level // 32
        at = ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        keys = _keyed(_majorities(tokens, starts), level, at[starts])
        late = _late(keys, frequent)
        out.append(np.concatenate([np.sort(keys[~late]), np.sort(keys[late])])[: most + 1])
        if len(keys) <= most:
            out.append(_keyed(tokens[: n - -(-p * n // q) + 1], level, np.full(1, count)))
    return np.concatenate(out)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bits as longs: whether the number of hashes with the same low bits is odd; 512 bits, or the power of two that holds the set if that is more."""
    bits = max(512, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _folded(odd: np.ndarray) -> np.ndarray:
    """The parities by the low 9 bits alone."""
    return np.bitwise_xor.reduce(odd.reshape(-1, 8), axis=0)


def _frequent(texts: DataFrame, least: tuple[int, int]) -> np.ndarray:
    def run(batches):
        for b in batches:
            found = [blocks(shingles(x), least) for x in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["key"])

    some = map_texts(texts.where(F.pmod("own", F.lit(SAMPLE)) == 0).select("text"), run, "key long")
    rows = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _sets(batches, held, least: tuple[int, int]):
    """(doc_id, own, fp of the set, n, keys, 512 parities, all if there are more) of (doc_id, own, text)."""
    longs = pa.list_(pa.int64())
    for b in batches:
        found = [shingles(x) for x in utf8(b.column(2))]
        fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in found], np.uint64).view(np.int64)
        odd = [parities(s) for s in found]
        new = [pa.array(fps), pa.array([len(s) for s in found], pa.int64()), pa.array([blocks(s, least, held.value).view(np.int64) for s in found], longs)]
        new += [pa.array([_folded(x) for x in odd], longs), pa.array([x if len(x) > 8 else x[:0] for x in odd], longs)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *new], names=["doc_id", "own", "fp", "n", "keys", "odd", "wide"])


def _whole(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).tobytes() for x in utf8(b.column(1))], pa.binary())], names=["fp", "whole"])


def _may(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether the sets na, oa, wa and nb, ob, wb can be similar enough by their sizes and the distances of their parities."""
    p, q = least
    n, m, x, y = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"w{a}"), F.col(f"w{b}")
    near = lambda apart: (p + q) * (n + m - apart) >= 2 * p * (n + m)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(f"o{a}", F.lit(i)).bitwiseXOR(F.get(f"o{b}", F.lit(i)))) for i in range(8)])
    size = F.least(F.size(x), F.size(y))  # of similar sizes one is at most twice the other
    same = lambda v: F.when(F.size(v) > size, F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, size + 1, size), lambda s, t: s.bitwiseXOR(t))).otherwise(v)
    wide = F.aggregate(F.zip_with(same(x), same(y), lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, t: s + t)
    return F.when((F.least(n, m) * q < F.greatest(n, m) * p) | ~near(apart), False).when(size > 0, near(wide)).otherwise(True)


def _side(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select(*columns, *[F.col(c).alias(f"{c[0]}{name}") for c in ("fp", "n", "odd", "wide") if c in df.columns])


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Of the pairs (fa, fb) of set prints, those that are similar enough, as (a, b)."""
    p, q = least
    known = nodes.select("fp", "n", "odd", "wide")
    near = pairs.distinct().join(_side(known, "a"), "fa").join(_side(known, "b"), "fb").where(_may("a", "b", least))
    pairs = stored(near.select("fa", "fb"), "candidates")
    asked = stored(nodes.select("fp", "own").join(pairs.select(F.col("fa").alias("fp")).unionAll(pairs.select(F.col("fb").alias("fp"))).distinct(), "fp", "left_semi"), "asked")
    held = texts.select("own", "text").join(bounded(asked), "own").select("fp", "text")
    held = stored(map_texts(held, _whole, "fp long, whole binary").dropDuplicates(["fp"]), "sets")
    of = lambda name: held.select(F.col("fp").alias(f"f{name}"), F.col("whole").alias(f"w{name}"))

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(w.as_py(), np.uint64) for w in b.column(i)] for i in (2, 3))
            good = [(p + q) * len(np.intersect1d(s, t, assume_unique=True)) >= p * (len(s) + len(t)) for s, t in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = stored(map_texts(pairs.join(of("a"), "fa").join(of("b"), "fb").select("fa", "fb", "wa", "wb"), run, "a long, b long"), "similar")
    dropped(pairs, asked, held)
    return out


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("fa"), F.greatest(x, y).alias("fb")]


def _mixed(members: DataFrame) -> DataFrame:
    """Of the members (key, fp, c) of blocks, those in blocks that hold several components c, with the block's members m."""
    several = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high")
    several = stored(several.select("key", "m"), "mixed")
    out = stored(members.select("key", "fp", "c").join(bounded(several), "key"), "members")
    dropped(several)
    return out


def _pairs_with_heads(members: DataFrame, heads: DataFrame, other: str) -> DataFrame:
    """(fa, fb) of members and their blocks' heads (key, head, ...), where ``other`` tells them apart."""
    return members.join(bounded(stored(heads, "heads")), "key").where(other).select(*_pair("fp", "head"))


def _all_pairs(members: DataFrame, few: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(fa, fb) of the pairs of few with members (key, fp, c, rare, n, odd, wide) of their blocks, in other components, that may be similar.

    Few are the rare members; a pair of two such is met once.
    """
    x, y = (_side(df, name, "key", F.col("c").alias(f"c{name}"), F.col("rare").alias(f"r{name}")) for df, name in ((few, "x"), (members, "y")))
    once = ~F.col("ry") | (F.col("fx") < F.col("fy"))
    return x.join(y, "key").where((F.col("cx") != F.col("cy")) & once).where(_may("x", "y", least)).select(*_pair("fx", "fy"))


def _links(nodes: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, component) of the nodes that have a link; the table of nodes is deleted on the way."""
    known = stored(nodes.select("fp", "own", "n", "odd", "wide"), "known")
    first = nodes.select("fp", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    heads = first.groupBy("key").agg(F.min("fp").alias("head"), F.max("fp").alias("high")).where("head < high").select("key", "head")
    links = [_verified(_pairs_with_heads(first, heads, "fp <> head"), known, texts, least)]
    linked = lambda: connected_components(reduce(DataFrame.unionAll, links))
    marked = lambda df, comps: df.join(comps, df["fp"] == comps["node"], "left").withColumn("c", F.coalesce("component", "fp")).drop("node", "component")
    rest = _mixed(marked(nodes.select("fp", "keys"), linked()).select("fp", "c", F.explode("keys").alias("key")))
    dropped(nodes)
    sketch = known.select("fp", "n", "odd", "wide")
    turn, before = 0, None
    while True:
        last, some = rest, rest.where(F.col("m") > SMALL) if turn else rest
        heads = some.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)), "fp", "c")).alias("h")).select("key", F.col("h.fp").alias("head"), F.col("h.c").alias("hc"))
        links.append(_verified(_pairs_with_heads(some, heads, "c <> hc"), known, texts, least))
        comps = linked()
        rest = _mixed(marked(rest.drop("c", "m"), comps))
        dropped(last)
        # Of two components in a block one is not its largest: only members of such a one are compared with all.
        each = rest.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key")
        most = stored(each.agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rare")), "most")
        left = most.agg(F.sum("rare").alias("rare"), F.sum("all").alias("all"), F.sum(F.col("rare").cast("double") * F.col("all")).alias("pairs")).first()
        if not left["rare"]:
            dropped(rest, most)
            return comps
        turn += 1
        if turn >= TURNS and (left["pairs"] <= max(LISTED, LISTED_EACH * left["all"]) or before and 10 * left["rare"] > 9 * before):
            break
        before = left["rare"]
        dropped(most)
    last, rest = rest, stored(rest.join(most.select("key", "most"), "key").withColumn("rare", F.col("c") != F.col("most")).drop("m", "most").join(sketch, "fp"), "members")
    dropped(last, most)
    found = stored(_all_pairs(rest, rest.where("rare"), least).distinct(), "found")
    links.append(_verified(found, known, texts, least))
    dropped(rest, found)
    return linked()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, own, root), one row per input row: the component of the row over links of similarity ``least`` or more.

    ``own`` is a hash of the text. Null and empty texts have no shingles and
    are copies of each other. Repeated rows stay repeated; no rows give none.
    Other columns are not read.
    """
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("own"), "text")
    held = docs.sparkSession.sparkContext.broadcast(_frequent(texts, least))
    schema = texts.drop("text").schema.add("fp", "long").add("n", "long")
    for name in ("keys", "odd", "wide"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    sets = stored(map_texts(texts, lambda it: _sets(it, held, least), schema), "sets")
    rows = stored(sets.select("doc_id", "own", "fp"), "rows")
    nodes = stored(sets.select("fp", "own", "n", "keys", "odd", "wide").dropDuplicates(["fp"]), "nodes")
    dropped(sets)
    comps = _links(nodes, texts, least)
    out = rows.join(comps, rows["fp"] == comps["node"], "left").select("doc_id", "own", F.coalesce("component", "fp").alias("root"))
    out = stored(out, "roots")
    dropped(rows)
    return out


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """The row with the smallest id of each component, all columns kept.

    Null ids come last. Of rows that agree in id and text one stays. Null and
    empty texts are copies of each other. Texts are only shuffled if more rows
    go than may be broadcast.
    """
    found = near_copies(docs, doc_id, text, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    rows = found.groupBy("root", "doc_id", "own").agg(F.count("*").alias("times")).join(best, "root")
    rows = stored(rows.select(F.col("doc_id").alias("id"), F.col("own").alias("hash"), "times", (order != F.col("best")).alias("goes")).where("goes or times > 1"), "goes")
    own = unused(docs, "own")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))

    def joined(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return df.join(bounded(rows), df[f"`{doc_id}`"].eqNullSafe(rows["id"]) & (df[own] == rows["hash"]), how)

    out = joined(keyed, rows.select("id", "hash"), "left_anti")
    repeated = rows.where("not goes").select("id", "hash")
    if not repeated.isEmpty():
        out = out.unionAll(joined(keyed, repeated, "left_semi").dropDuplicates([doc_id, own]))
    return out.drop(own)
