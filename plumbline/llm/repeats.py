"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every 13 consecutive 8-word hashes the smallest
is kept, so that each window of 20 words has exactly one anchor and equal
windows have equal anchors. Documents meet on anchors that occur at least
twice; from each such seed the match is extended to the left and to the right
over all windows that hold the anchor. A seed's documents are not compared two
by two, as a third of all may share one: each of its windows is joined by the
hash of its words (64 and 32 bits, of two polynomials over different word
hashes) with the earliest document that has it. Covered windows merge into
maximal repeats of at least 20 words; the earliest copy stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_texts, table, utf8

MIN_WORDS, ANCHOR_WORDS = 20, 8
#: Bits of the seed filter: per seed, at least, and at most. Beyond the last, more windows than needed are compared; results stay the same.
SEED_BITS, LEAST_BITS, MOST_BITS = 12, 16, 30
_SHIFTS = (0, 16, 33)
_NULL_ID = -(1 << 63)
_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FLUSH, _SHIFT = 400_000, 20
#: Bytes of a word that are tabulated, and words that are hashed at a time.
LONG, _WORDS = 64, 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _tabulation(places: int) -> np.ndarray:
    """A 64-bit number for every byte at each of so many places of a word."""
    at = np.arange(256 * places, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return _mix(_mix(at * _B + _C, 0xD6E8FEB86659FD93), 0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray, c: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(c)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(words: np.ndarray, n: int, at: np.uint64 = _B) -> np.ndarray:
    """Polynomial hash (the polynomial's value ``at`` a point) of every n consecutive word hashes, by doubling."""
    done, power, length, step, base = None, None, 0, words, at
    size = 1
    while True:
        if n & size:
            if done is None:
                done, length = step, size
            else:  # step covers `size` words, done the `length` words after them
                done = step[: max(0, len(done) - size)] * power + done[size:]
                length += size
            power = _pow(length, at)
        if size * 2 > n:
            return done
        step = step[: max(0, len(step) - size)] * base + step[size:]
        base = base * base
        size *= 2


def _pow(n: int, at: np.uint64) -> np.uint64:
    return np.uint64(pow(int(at), n, 1 << 64))


_TABLE = _tabulation(LONG)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: sums of tabulated numbers of their bytes, or XXH64 for long words."""
    text = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[text]
    none = np.zeros(1, np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([none, inside.view(np.int8), none])))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    for first in range(0, len(starts), _WORDS):
        n = np.minimum(lengths[first : first + _WORDS], LONG)
        offsets = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(offsets, n)
        own = text[place + np.repeat(starts[first : first + _WORDS], n)]
        out[first : first + _WORDS] = np.add.reduceat(_TABLE[own.astype(np.int64) * LONG + place], offsets)
    out = _mix(out, 0x94D049BB133111EB)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], 7)
    return out


def _anchor_grams(words: np.ndarray, min_words: int) -> tuple[np.ndarray, int]:
    """Hashes of all runs of anchor length, and how many of them a window has."""
    k = min(ANCHOR_WORDS, min_words)
    with np.errstate(over="ignore"):
        return _mix(_grams(words, k), 0x94D049BB133111EB), min_words - k + 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive numbers, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchor_places(words: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """The anchors of a text's windows, one number an anchor and place: of equal ones in a window the last counts."""
    if len(words) < min_words:
        return np.zeros(0, np.uint64)
    grams, width = _anchor_grams(words, min_words)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.empty(len(view), np.int64)
    for i in range(0, len(view), 200_000):
        at[i : i + 200_000] = width - 1 - view[i : i + 200_000, ::-1].argmin(axis=1)
    at += np.arange(len(view))
    return grams[at[np.flatnonzero(np.diff(at, prepend=-1))]]


def window_anchors(words: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Every window's anchor."""
    if len(words) < min_words:
        return np.zeros(0, np.uint64)
    return _least(*_anchor_grams(words, min_words))


def window_hashes(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window's words (64 and 32 bits)."""
    with np.errstate(over="ignore"):
        first = _mix(_grams(words, min_words), 0xD6E8FEB86659FD93)
        second = (_mix(_grams(_mix(words, 0xFF51AFD7ED558CCD), min_words, _C), 0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return first, second


class SeedFilter:
    """A Bloom filter of the seeds, with positions cut from the 64-bit hash itself."""

    def __init__(self, words: np.ndarray, log2: int):
        self.words, self.mask = words, np.uint64((1 << log2) - 1)

    def __contains__(self, x):
        return bool(self.holds(np.array([x], np.uint64))[0])

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for s in _SHIFTS:
            at = (x >> np.uint64(s)) & self.mask
            found &= ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


def _anchors(batches, min_words: int):
    """(anchor, times) per group of batches."""
    held, size = [], 0

    def out():
        a, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(times.astype(np.int64))], names=["anchor", "times"])

    for b in batches:
        for data in utf8(b.column(0)):
            held.append(anchor_places(word_hashes(data), min_words))
            size += len(held[-1])
            if size > _FLUSH:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def _seed_filter(seeds: DataFrame) -> SeedFilter:
    n = seeds.count()
    log2 = min(MOST_BITS, max(LEAST_BITS, (n * SEED_BITS).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("anchor", s).bitwiseAND(F.lit((1 << log2) - 1)) for s in _SHIFTS]))
    bits = seeds.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(max(1, (1 << log2) // 64), np.int64)
    for part in bits.select(F.pmod("word", F.lit(64)).alias("p"), "word", "bits").groupBy("p").agg(F.collect_list(F.struct("word", "bits")).alias("rows")).toLocalIterator():
        got = np.array([(r["word"], r["bits"]) for r in part["rows"]], np.int64)
        words[got[:, 0]] = got[:, 1]
    return SeedFilter(words.view(np.uint64), log2)


def _both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit name of a window within its document."""
    return first ^ (second.astype(np.int64).view(np.uint64) << np.uint64(_SHIFT))


def _seeded(batches, min_words: int, held):
    """(first, second, doc) of the distinct windows on a seed, per document."""
    seeds, names = held.value, ["first", "second", "doc"]
    for b in batches:
        cols = ([], [], [])
        for doc, data in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            words = word_hashes(data)
            on = np.flatnonzero(seeds.holds(window_anchors(words, min_words)))
            if len(on):
                first, second = window_hashes(words, min_words)
                _, own = np.unique(_both(first[on], second[on]), return_index=True)
                cols[0].append(first[on][own].view(np.int64))
                cols[1].append(second[on][own])
                cols[2].append(np.full(len(own), doc, np.int64))
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)


def merged(covered: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cut(batches, min_words: int, held):
    """Spans and kept text of each document, given the windows that it has first."""
    seeds = held.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        texts, firsts = utf8(b.column(b.num_columns - 2)), b.column(b.num_columns - 1)
        n_words, spans, kept = [], [], []
        for i, data in enumerate(texts):
            words = data.split()
            hashes = word_hashes(data)
            later = seeds.holds(window_anchors(hashes, min_words))
            on = np.flatnonzero(later)
            if len(on):
                name = _both(*window_hashes(hashes, min_words))
                _, own = np.unique(name[on], return_index=True)
                earliest = on[own]
                mine = firsts[i].values
                if mine is not None:
                    later[earliest[np.isin(name[earliest].view(np.int64), mine.to_numpy(zero_copy_only=False))]] = False
            marks = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(later)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + min_words, -1)
            gone = np.cumsum(marks)[: len(words)] > 0
            n_words.append(len(words))
            spans.append([{"start": s, "end": e} for s, e in merged(gone)])
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans[-1] else words).decode())
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n_words, pa.int32()), pa.array(spans, kind), pa.array(kept, pa.string())], names=[*b.schema.names[:-2], "n_words", "spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, kept): every row with its maximal repeats, in words, and the text without them.

    A word goes if a window of ``min_words`` words that covers it also starts
    earlier, in a smaller id or earlier in the same document. ``doc_id`` is an
    integer; a null id counts as smaller than all others. Rows that share an
    id are one document at the same positions: neither is earlier. Null and
    empty texts have no words. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = base.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "text")
    anchors = map_texts(base.select("text"), lambda it: _anchors(it, min_words), "anchor long, times long")
    seeds = stored(anchors.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor"), "seeds")
    held = spark.sparkContext.broadcast(_seed_filter(seeds))
    on_seed = map_texts(keyed, lambda it: _seeded(it, min_words, held), "first long, second int, doc long")
    first = on_seed.groupBy("first", "second").agg(F.min("doc").alias("doc"))
    name = F.col("first").bitwiseXOR(F.shiftleft(F.col("second").cast("long"), _SHIFT))
    first = first.groupBy("doc").agg(F.collect_list(name).alias("firsts"))
    cut = map_texts(keyed.join(first, "doc", "left").select(F.expr(f"nullif(doc, {_NULL_ID}L)").alias("doc_id"), "text", "firsts"), lambda it: _cut(it, min_words, held), "doc_id long, n_words int, spans array<struct<start:int,end:int>>, kept string")
    return cut


def op4_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by an earlier 20-word window are removed from every document."""
    found = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
