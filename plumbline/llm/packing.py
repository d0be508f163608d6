"""Best-fit packing by length patterns.

Documents become token ids; only those longer than a sequence are cut. The
histogram of piece lengths (at most one bin per length, however many
documents) is fitted by non-negative least squares over patterns of two
to four lengths that fill a sequence; repeat counts are rounded down,
and the residual is packed best-fit decreasing, still by counts. Pieces then
take the slots of their length by rank. Only the histogram and the plan pass
through the driver, and both are bounded by the sequence length; where a rank
group begins within its length is counted and joined as a table.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_texts, table, utf8

SEQUENCE, END_ID = 1024, 2
#: Pieces that one rank group should hold; the number of groups per length grows with the pieces.
RANK_ROWS, LEAST_SALTS = 200_000, 64
#: Bytes of token units and their ids that a worker keeps unless told otherwise, and those that an entry takes beside them.
MEMO_BYTES, MEMO_ENTRY = 160 << 20, 190
_BREAK, _LOOSE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s|^ | $")
_SPECIAL = re.compile(r"<\|endoftext\|>")
#: Units of these code points are the same to both libraries' splitting expressions.
_LATIN = re.compile("[\x00-\u024f]*")


class Encoder:
    """Ids of whole texts as little-endian 32-bit words, with a memo of units.

    A byte-level BPE never merges across a single space between two
    non-spaces, so a text's ids are those of its space-led units in order.
    Every unit is encoded once: by the tokenizer, or, for Latin units and if
    the same vocabulary is given as ranks, by the faster library that reads
    ranks. Texts with the special token go whole through the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None, memo_bytes: int | None = None):
        self.path, self.memo, self.size, self.fast = path, {}, 0, None
        self.most = MEMO_BYTES if memo_bytes is None else memo_bytes
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = (line.split() for line in f)
                self.fast = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        """Loaded when a unit first needs it, as it is large."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = [array("I", self.fast(t)).tobytes() if _LATIN.fullmatch(t) and not _SPECIAL.search(t) else None for t in texts]
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        units = []
        for t in texts:
            if not t or _SPECIAL.search(t):
                units.append(None)
                continue
            parts = _BREAK.split(t) if _LOOSE.search(t) else t.split(" ")
            units.append([parts[0], *[" " + p for p in parts[1:]]])
        if self.size > self.most:  # what the present batch adds is bounded by its texts
            self.memo.clear()
            self.size = 0
        new = list({u for us in units if us for u in us if u not in self.memo})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = self._ids(some)
            self.memo.update(zip(some, ids, strict=True))
            self.size += MEMO_ENTRY * len(some) + sum(map(len, some)) + sum(map(len, ids))
        memo = self.memo.__getitem__
        return [b"".join(map(memo, us)) if us else self._ids([t])[0] if t else b"" for t, us in zip(texts, units, strict=True)]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*settings) -> Encoder:
    if settings not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[settings] = Encoder(*settings)
    return _ENCODERS[settings]


def cuts(length: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences but for the first."""
    first = length % sequence or sequence if length > sequence else length
    return [(0, first)] + [(s, sequence) for s in range(first, length, sequence)]


def _pieces(batches, settings: tuple, sequence: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
    end = np.array([END_ID], "<u4").tobytes()
    for b in batches:
        rows, kept = [], []
        for doc, ids in zip(b.column(0).to_pylist(), _encoder(*settings).encode([x.decode() for x in utf8(b.column(1))]), strict=True):
            ids += end
            rows += [(doc, i, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cuts(len(ids) // 4, sequence))]
            kept.append(ids)  # a document's pieces are its ids in order
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
        if with_ids:
            ends = np.cumsum([0] + [r[3] for r in rows]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def patterns(present: np.ndarray, sequence: int) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths, longest first, that fill a sequence exactly."""
    have = sorted(np.flatnonzero(present).tolist())

    def best(room: int) -> int:
        i = bisect_left(have, room + 1)
        return have[i - 1] if i else 0

    found: set[tuple[int, ...]] = set()
    for a in have:
        room = sequence - a
        found.add((a, best(room)))
        for part in (0.5, 0.6, 0.7, 0.8, 0.9):
            if b := best(int(room * part)):
                found.add((a, b, best(room - b)))
                if d := best(int((room - b) * 0.6)):
                    found.add((a, b, d, best(room - b - d)))
    return sorted({tuple(sorted(p, reverse=True)) for p in found if sum(p) == sequence and 0 not in p})


def nonnegative_fit(plans: list[tuple[int, ...]], target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |Ax - target|, A counting each length in each pattern (accelerated projected gradient)."""
    width = max(map(len, plans))
    at = np.array([p + (0,) * (width - len(p)) for p in plans])
    used = (at > 0).astype(float)

    def ahead(x):
        return np.bincount(at.ravel(), (used * x[:, None]).ravel(), minlength=len(target))

    def back(r):
        return (r[at] * used).sum(axis=1)

    v = np.ones(len(plans))
    for _ in range(30):
        v = back(ahead(v))
        v /= (norm := np.linalg.norm(v))
    x = y = np.zeros(len(plans))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(ahead(y) - target) / (norm * 1.01))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    return x


def best_fit_counts(left: np.ndarray, sequence: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over counts of lengths: patterns and how often each is used."""
    rooms: list[int] = []  # of open sequences, sorted
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def put(room: int, plan: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][plan] = open_[room].get(plan, 0) + n

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                plan, there = next(iter(open_[room].items()))
                each = min(room // length, n)
                take = min(there, n // each)
                n -= take * each
                if take == there:
                    del open_[room][plan]
                    if not open_[room]:
                        del open_[room], rooms[i]
                else:
                    open_[room][plan] -= take
                put(room - each * length, plan + (length,) * each, take)
            else:
                each = min(sequence // length, n)
                take = n // each
                n -= take * each
                put(sequence - each * length, (length,) * each, take)
    out: dict[tuple[int, ...], int] = {}
    for group in open_.values():
        for plan, n in group.items():
            out[plan] = out.get(plan, 0) + n
    return out


#: Shares of the fitted repeat counts that are tried; the fewest sequences win.
SHARES = (1.0, 0.98, 0.9)


def _with_share(left: np.ndarray, plans: list[tuple[int, ...]], x: np.ndarray, sequence: int) -> dict[tuple[int, ...], int]:
    """Patterns repeated as often as the fit says, rounded down to what is there; the residual by best fit."""
    left, out = left.copy(), {}
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 1:
            break
        need = np.bincount(plans[i])
        own = np.flatnonzero(need)
        if n := min(int(x[i]), int((left[own] // need[own]).min())):
            left[own] -= n * need[own]
            out[plans[i]] = n
    for plan, n in best_fit_counts(left, sequence).items():
        out[plan] = out.get(plan, 0) + n
    return out


def plan_sequences(counts: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, sequences) that hold exactly counts[length] pieces of each length."""
    left = counts.astype(np.int64).copy()
    whole, left[sequence] = int(left[sequence]), 0
    best: dict[tuple[int, ...], int] = {}
    if left.any():
        plans = patterns(left > 0, sequence)
        x = nonnegative_fit(plans, left.astype(float)) if plans else np.zeros(0)
        best = min((_with_share(left, plans, x * share, sequence) for share in SHARES), key=lambda out: sum(out.values()))
    return list(best.items()) + ([((sequence,), whole)] if whole else [])


class Slots:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        rows, base, given = [], 0, {}
        for pattern, n in plan:
            offset = 0
            for length in sorted(set(pattern), reverse=True):
                times = pattern.count(length)
                rows.append((length, given.get(length, 0), base, times, offset))
                given[length] = given.get(length, 0) + n * times
                offset += length * times
            base += n
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.keys = (self.rows[:, 0] << 44) + self.rows[:, 1]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[np.searchsorted(self.keys, (length << 44) + rank, side="right") - 1]
        nth = rank - r[:, 1]
        return r[:, 2] + nth // r[:, 3], r[:, 4] + nth % r[:, 3] * length


def _place(batches, held):
    """Sequence and offset in place of the last two columns, a piece's rank within its length in two parts."""
    for b in batches:
        length, before, nth = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "before", "nth"))
        sequence, offset = held.value.find(length, before + nth)
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-2], "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, with_ids: bool = False, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row and its place; if asked for, its ids too.

    A row's ids are the tokenizer's and then id 2; null and empty texts have
    that one. Rows that share an id, null too, are packed each for itself. No
    rows give no pieces. Other columns are not read. ``memo_bytes`` bounds what
    a worker keeps of encoded units and changes no result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    columns = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = stored(map_texts(base, lambda it: _pieces(it, (tokenizer, ranks, memo_bytes), sequence, with_ids), columns), "pieces")
    salts = max(LEAST_SALTS, pieces.count() // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "rank-groups")
    counts = np.zeros(sequence + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length, at most sequence
        counts[r["length"]] = r["n"]
    held = docs.sparkSession.sparkContext.broadcast(Slots(plan_sequences(counts, sequence)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).select(*pieces.columns, "before", "nth")
    return ranked.mapInArrow(lambda it: _place(it, held), f"{columns}, sequence_id long, offset long")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    packed = pack(table(spark, sf_dir, "documents", "doc_id", "text"))
    return packed.withColumn("length", F.col("length").cast("long"))
