"""Benchmark decontamination with an FM-index per training shard.

Each shard of a partition's documents becomes one word string: words that no
benchmark item holds, and document ends, are separators (they can be in no
occurrence), and runs of words too short for any phrase are left out. The
string's suffixes are sorted by prefix doubling, its Burrows-Wheeler
transform is kept as a wavelet matrix, all phrases are searched backwards at
once, and occurrences are located by walking to sampled suffix positions.
Occurrences merge into the spans to remove.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored
from .common import map_texts, table, unused, utf8, without
from .repeats import merged

WINDOW = 10
#: Text bytes of a shard, and benchmark bytes of a block of phrases. Blocks are searched one after another, and each is
#: dropped before the next is sent: an executor holds one, some ten times its text.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
SAMPLE_EVERY = 8
#: Lower-cases A-Z; bytes that are in no word become spaces (all bytes of non-ASCII code points are word bytes).
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence, a bit vector for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.levels = len(seq), max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(len(bits) - int(bits.sum()))
            seq = np.concatenate([seq[~bits], seq[bits]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] is among the first at[i] of the sequence."""
        start = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, at), self._ones(level, start)
            at = np.where(one, self.zeros[level] + a, at - a)
            start = np.where(one, self.zeros[level] + b, start - b)
        return at - start


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of a string that ends with 0; the zeros are separators, each smaller than all letters and ordered by position."""
    n = len(s)
    zero = s == 0
    rank = np.zeros(n, np.int64)
    key = np.where(zero, np.arange(n), s.astype(np.int64) + n)
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[sa]) != 0])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = heads
    h = 1
    while True:
        same = ~new
        open_ = same | np.concatenate([same[1:], [False]])
        at = np.flatnonzero(open_)
        if not len(at):
            return sa
        pos = sa[at]
        pair = rank[pos] * (n + 1) + rank[pos + h]
        order = np.argsort(pair, kind="stable")
        sa[at] = pos[order]
        pair = pair[order]
        new = np.ones(n, bool)
        new[at] = np.concatenate([[True], np.diff(pair) != 0])
        rank[sa[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        h *= 2


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        """s: letters 1..sigma-1 and separators 0, ending with 0."""
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.bwt[sa == 0] = 0
        self.tree = WaveletMatrix(self.bwt, sigma)
        counts = np.bincount(s, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # rows that start with a smaller letter
        kept = (sa % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.kept, self.at, self.sample = kept, np.cumsum(kept) - 1, sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of all phrases; phrases: letters right-aligned in a matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, -back].astype(np.int64)
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows, by steps back to a sampled one."""
        out, steps, left, row = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.kept[row]
            out[left[done]] = self.sample[self.at[row[done]]] + steps
            left, row = left[~done], row[~done]
            c = self.bwt[row].astype(np.int64)
            row = self.first[c] + self.tree.rank(c, row)
            steps += 1
        return out


class Phrases:
    """A block of benchmark items as distinct windows over the letters of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.letters: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, data in items:
            ids = [self.letters.setdefault(w, len(self.letters) + 1) for w in words_of(data)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        keys = sorted(found)
        self.items = [sorted(x for x in found[k] if x is not None) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.shortest = int(self.lengths.min()) if keys else 0
        self.matrix = np.zeros((len(keys), window), np.int32)
        for i, k in enumerate(keys):
            self.matrix[i, window - len(k) :] = k

    def search(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Of each document of a shard: the merged spans of words inside occurrences, and the items."""
        out = [([], set()) for _ in docs]
        if not len(self.lengths):
            return out
        ends = np.cumsum([len(d) + 1 for d in docs])
        s = np.zeros(int(ends[-1]) if len(docs) else 0, np.int32)
        for d, end in zip(docs, ends.tolist(), strict=True):
            s[end - len(d) - 1 : end - 1] = np.fromiter(map(self.letters.get, d, repeat(0)), np.int32, len(d))
        stops = np.flatnonzero(s == 0)
        begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        long = stops - begins >= self.shortest
        if not long.any():
            return out
        lengths = (stops - begins + 1)[long]
        starts = np.cumsum(lengths) - lengths
        where = np.arange(int(lengths.sum())) + np.repeat(begins[long] - starts, lengths)  # places in s of the kept runs
        index = FMIndex(s[where], len(self.letters) + 1)
        lo, hi = index.search(self.matrix, self.lengths)
        hits = np.flatnonzero(hi > lo)
        n = (hi - lo)[hits]
        if not len(hits):
            return out
        rows = np.arange(int(n.sum())) + np.repeat(lo[hits] - (np.cumsum(n) - n), n)
        at, phrase = where[index.locate(rows)], np.repeat(hits, n)
        marks = np.zeros(len(s) + 1, np.int32)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + self.lengths[phrase], -1)
        covered = np.cumsum(marks)[:-1] > 0
        doc = np.searchsorted(ends, at, side="right")
        for d in np.unique(doc).tolist():
            begin = int(ends[d]) - len(docs[d]) - 1
            out[d] = (merged(covered[begin : int(ends[d])]), {x for p in np.unique(phrase[doc == d]).tolist() for x in self.items[p]})
        return out


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """Blocks of items of bounded bytes, read one partition at a time; at least one, which may be empty."""
    block, size, n = [], 0, 0
    for r in benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).toLocalIterator():
        data = (r["t"] or "").encode()
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size, n = [], 0, n + 1
        block.append((r["i"], data))
        size += len(data)
    if block or not n:
        yield block


def _union(a: list[dict], b: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted([(x["start"], x["end"]) for x in a] + b):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(batches, held, cut_at: int | None = None):
    """Add a block's findings; the last four columns are the text, n_words, spans and items so far.

    With ``cut_at``, the last block's: the spans are cut out of that column, and the four go.
    """
    phrases: Phrases = held.value
    for b in batches:
        texts, spans, items = utf8(b.column(b.num_columns - 4)), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        n_words, i = [], 0
        while i < len(texts):
            shard, size = [], 0
            while i + len(shard) < len(texts) and (not shard or size < SHARD_BYTES):
                size += len(texts[i + len(shard)])
                shard.append(words_of(texts[i + len(shard)]))
            for j, (found, names) in enumerate(phrases.search(shard)):
                if found:
                    spans[i + j] = _union(spans[i + j], found)
                    items[i + j] = sorted({*items[i + j], *names})
            n_words += map(len, shard)
            i += len(shard)
        if cut_at is None:
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n_words, pa.int32()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=b.schema.names)
        else:
            yield _cut(b.select(b.schema.names[:-4]), texts, spans, cut_at)


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, names: tuple[str, str, str], cut: bool = False) -> DataFrame:
    """All rows and columns with the number of words, the spans and the items as new columns of these names; or without these and with the spans cut out of the text."""
    words, spans, items = names
    body = unused(docs, "text_to_search")
    out = docs.withColumn(body, F.col(f"`{text}`").cast("string"))
    out = out.withColumns({words: F.lit(0), spans: F.expr("cast(array() as array<struct<start:int,end:int>>)"), items: F.expr("cast(array() as array<string>)")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    at = docs.columns.index(text) if cut else None
    blocks = _blocks(benchmark, item_id, item_text)
    block = next(blocks)
    while block is not None:
        held = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        block = next(blocks, None)
        if block is None and cut:
            return map_texts(out, lambda it, held=held: _search(it, held, at), docs.schema)
        out = map_texts(out, lambda it, held=held: _search(it, held), schema)
        if block is not None:  # another block follows: what was found so far is written, and its phrases go
            out = stored(out, "searched")
            held.unpersist()
    return out.drop(body)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add n_words, hit_spans (words inside any occurrence of a window, merged) and hit_items to every row.

    An item's windows are its runs of ``window`` words; an item of fewer words
    is one window, an item of none (or null) has no window. Null texts have no
    words. An item with a null id marks words but is not listed; ids compare
    as strings. Input columns named as the new ones are replaced; repeated
    rows stay repeated, and no rows give none.
    """
    names = ("n_words", "hit_spans", "hit_items")
    return _searched(without(docs, *names), benchmark, text, item_id, item_text, window, names)


_BYTES_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(data: bytes, spans: list[dict]) -> bytes:
    """The text without its spans of words, from a span's first word to its last."""
    places = [m.span() for m in _BYTES_WORD.finditer(data)]
    out, at = [], 0
    for s in spans:
        out.append(data[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, data[at:]])


def _cut(b: pa.RecordBatch, texts: list[bytes], spans: list, at: int) -> pa.RecordBatch:
    """The batch with the spans cut out of the texts of column ``at``; other texts stay as they are."""
    if not any(spans):
        return b
    new = pa.array([cut_spans(x, s).decode() if s else None for x, s in zip(texts, spans, strict=True)], pa.string())
    new = pc.if_else(pa.array([bool(s) for s in spans]), new, b.column(at))
    return pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], names=b.schema.names)


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Cut every occurrence of the benchmark's windows out of the texts.

    All rows and all other columns stay, whatever these are named. Null texts
    stay null, texts without an occurrence as they are, to the byte.
    """
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    names = tuple(unused(docs, n) for n in ("n_words", "hit_spans", "hit_items"))
    return _searched(docs, benchmark, text, item_id, item_text, window, names, cut=True)


def hit_words(spans: str | Column = "hit_spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of the benchmark's 10-word windows."""
    found = find_benchmark(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("text")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
