"""Stupid-backoff language-model scores by joins of packed n-grams.

The model's n-grams (orders 1 to 3) are those that occur at least ``least``
times in the corpus, for the query all (``least`` = 1).
S(w | u v) = c(uvw) / c(uv) if uvw is in the model, else 0.4 S(w | v), and so
on down to c(w) / N, with c = 1 for words that occur once.

Documents are gathered into chunks of about a million words, kept as word
numbers beside the hashes of the chunk's words. A chunk's distinct n-grams are
exploded by the high bits of their 64-bit hashes into parts, one row a chunk
and part that holds sorted hashes as packed differences. Each part's rows make
its count table and are joined to it there; what goes back to the chunk is one
packed count for each n-gram asked for. Words and pairs go first; then those
triples alone of which both pairs occur twice: the count of any other is 1.
Logarithms are summed per document.

An n-gram is sent once a chunk however often it occurs, parts are cut by hash,
and their number grows with the corpus: no frequent n-gram, long document or
group of copies makes a part larger than others. Rows number chunks times
parts, so packing gains less the more parts there are, but there are never
more rows than n-grams.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_texts, table, utf8
from .repeats import _mix

BACKOFF = 0.4
#: Words of a chunk (a longer document is a chunk alone), n-grams of a part, and the least number of parts as a power of two.
CHUNK_WORDS, PART_GRAMS, LEAST_PART_BITS = 1 << 20, 1 << 20, 9
#: Chunks or packed rows of one Arrow batch.
_BATCH = 8
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_CHUNK = "chunk long, words long, docs array<long>, lengths array<int>, vocabulary binary, numbers binary"
_ASKED = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("grams", pa.binary()), ("times", pa.binary())])


def packed(x: np.ndarray) -> bytes:
    """64-bit unsigned numbers as planes of bytes, as many as the largest number needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


class _Numbers(dict):
    """Words by order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(batches, chunk_words: int):
    """Rows of _CHUNK: words lower-cased (A-Z) and split at white space."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["chunk", "words", "docs", "lengths", "vocabulary", "numbers"]
    docs, lengths, numbers, known, size = [], [], [], _Numbers(), 0

    def out():
        vocabulary = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in known), np.uint64, len(known)).tobytes()
        row = [uuid.uuid4().int >> 65, sum(lengths), docs, lengths, vocabulary, packed(np.concatenate(numbers).astype(np.uint64))]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    for b in batches:
        for doc, data in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            words = data.lower().split()
            docs.append(doc)
            lengths.append(len(words))
            numbers.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            size += len(words) + 1
            if size >= chunk_words:
                yield out()
                docs, lengths, numbers, known, size = [], [], [], _Numbers(), 0
    if docs:
        yield out()


def grams(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a chunk (a row of _CHUNK): its hash, those of the pair and triple that end there, its place in its document; and the documents' lengths.

    There is no pair at place 0, and no triple at 0 and 1: what stands there has no meaning.
    """
    lengths = np.array(chunk["lengths"], np.int64)
    one = np.frombuffer(chunk["vocabulary"], np.uint64)[unpacked(chunk["numbers"]).astype(np.int64)]
    at = np.arange(len(one)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    two, three = np.zeros_like(one), np.zeros_like(one)
    with np.errstate(over="ignore"):
        two[1:] = _mix(one[:-1] * _M[0] + one[1:], 0xD6E8FEB86659FD93)
        three[1:] = _mix(two[:-1] * _M[1] + one[1:], 0xFF51AFD7ED558CCD)
    return one, two, three, at, lengths


def _requests(chunk: int, got: np.ndarray, bits: int) -> pa.Table:
    """(chunk, part, grams, times): a chunk's distinct n-grams by part, and how often it holds them."""
    shift = np.uint64(64 - bits)
    keys, times = np.unique(got, return_counts=True)
    parts, starts = np.unique(keys >> shift, return_index=True)
    spans = zip(parts.tolist(), starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True)
    rows = [(chunk, p, packed(np.diff(keys[s:e], prepend=np.uint64(p << int(shift)))), packed(times[s:e])) for p, s, e in spans]
    return pa.Table.from_pylist([dict(zip(_ASKED.names, r, strict=True)) for r in rows], _ASKED)


def _ask_short(batches, bits: int):
    """Requests for the words and pairs of chunks."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            one, two, _, at, _ = grams(row)
            yield from _requests(row["chunk"], np.concatenate([one, two[at >= 1]]), bits).to_batches()


def _answers(rows: pa.Table, bits: int) -> pa.Table:
    """(chunk, part, counts) of one part: its count table, joined to the rows that it was made from."""
    floor = np.uint64(rows["part"][0].as_py() << (64 - bits))
    each = [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) + floor for x in rows["grams"]]
    keys, times = np.concatenate(each), np.concatenate([unpacked(x.as_py()) for x in rows["times"]])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.empty(len(keys), np.uint64)
    counts[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(first, append=len(keys)))
    back = [packed(c) for c in np.split(counts, np.cumsum([len(x) for x in each])[:-1])]
    return pa.table({"chunk": rows["chunk"], "part": rows["part"], "counts": pa.array(back, pa.binary())})


def _counts(got: np.ndarray, answers: pa.Table, order: int) -> np.ndarray:
    """The corpus counts of a chunk's n-grams, of what was asked for as ``order``."""
    rows = answers.filter(pc.equal(answers["longest"], order)).sort_by("part")
    counts = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x.as_py()) for x in rows["counts"])])
    return counts[np.unique(got, return_inverse=True)[1]]


def _short_counts(one: np.ndarray, two: np.ndarray, at: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the word and the pair (0: none) that end at each word, and whether a triple that ends there may occur twice: both its pairs do."""
    has = at >= 1
    counts = _counts(np.concatenate([one, two[has]]), answers, 2)
    c2 = np.zeros(len(one), np.uint64)
    c2[has] = counts[len(one) :]
    known = c2 > 1
    return counts[: len(one)], c2, (at >= 2) & known & _before(known)


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])[: len(x)]


def _ask_triples(chunk: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Requests for the triples of a chunk that may occur twice."""
    row = chunk.to_pylist()[0]
    one, two, three, at, _ = grams(row)
    return _requests(row["chunk"], three[_short_counts(one, two, at, answers)[2]], bits)


def _scores(chunk: pa.Table, answers: pa.Table, total: int, least: int) -> pa.Table:
    """(doc, words, sum) of one chunk's documents."""
    row = chunk.to_pylist()[0]
    one, two, three, at, lengths = grams(row)
    c1, c2, may = _short_counts(one, two, at, answers)
    c3 = (at >= 2).astype(np.uint64)
    c3[may] = _counts(three[may], answers, 3)
    log1, log2, log3 = (np.log(np.maximum(c, 1)) for c in (c1, c2, c3))
    order, penalty = np.minimum(at + 1, 3), math.log(BACKOFF)
    by_pair = log2 - _before(log1) + penalty * (order - 2)
    by_word = log1 - math.log(max(total, 1)) + penalty * (order - 1)
    value = np.where(c3 >= least, log3 - _before(log2), np.where(c2 >= least, by_pair, by_word))
    sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), value, len(lengths))
    return pa.table({"doc": pa.array(row["docs"], pa.int64()), "words": pa.array(lengths), "sum": pa.array(sums, pa.float64())})


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS, part_grams: int = PART_GRAMS, least: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score): the sum of the natural logarithms of S over each document's words.

    Words are runs of non-space characters, A-Z lower-cased. Rows that share an
    id are scored together and return one row, null ids too. Documents without
    words (null, empty) have 0 words and 0.0. Other columns are not read.
    Pairs and triples that occur less than ``least`` times (1 or more) are not
    in the model. ``chunk_words`` and ``part_grams`` bound what a task holds and change no
    result.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    chunks = stored(map_texts(base, lambda it: _chunks(it, chunk_words), _CHUNK), "chunks")
    total = chunks.agg(F.sum("words").alias("n")).first()["n"] or 0
    bits = max(LEAST_PART_BITS, math.ceil(math.log2(max(1, 2 * total / part_grams))))
    chunks = chunks.drop("words")
    by_chunk = chunks.groupBy("chunk")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH))

    def answered(requests: DataFrame, longest: int) -> DataFrame:
        found = requests.groupBy("part").applyInArrow(lambda rows: _answers(rows, bits), "chunk long, part long, counts binary")
        return stored(found.withColumn("longest", F.lit(longest)), "answers")

    asked = "chunk long, part long, grams binary, times binary"
    short = answered(chunks.mapInArrow(lambda it: _ask_short(it, bits), asked), 2)
    triples = answered(by_chunk.cogroup(short.groupBy("chunk")).applyInArrow(lambda chunk, back: _ask_triples(chunk, back, bits), asked), 3)
    scored = by_chunk.cogroup(short.unionAll(triples).groupBy("chunk")).applyInArrow(lambda chunk, back: _scores(chunk, back, total, least), "doc long, words long, sum double")
    return scored.groupBy(F.col("doc").alias("doc_id")).agg(F.sum("words").alias("n_words"), F.sum("sum").alias("log_score"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score a word of every document, under the model of all documents."""
    found = backoff_scores(table(spark, sf_dir, "documents", "doc_id", "text"), least=1)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))
