"""Quality rules by distribution divergence.

Each text gives a histogram of character classes and one of common words. The
references of a language are the mean histograms of its documents that pass
the base rule, taken twice: the second time over those near the first
reference. A document is kept if, for the nearest language, the Jensen-Shannon
distances stay under their thresholds; each distance counts only for texts
long enough to measure it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored
from .common import map_texts, table, utf8, without

#: Common words of the languages that references are made for.
COMMON = {
    "en": "the of and to a in that is was it for on with as be at by this from are or an not which have",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce avec son",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o sus",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
#: The symbols of the base rule.
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "control", "two-byte", "three-byte", "four-byte")
#: (words that a text needs, distance that then fails it) of each histogram, and how near a document is to refine a reference.
LIMITS = {"chars": ((50, 0.21), (100, 0.17)), "words": ((200, 0.3),)}
REFINE = {"chars": 0.15, "words": 0.4}
#: Documents that a language needs for a reference, and the references that a batch is compared with at a time.
LEAST_DOCS, REFERENCE_BLOCK = 5, 64

_WORD_BIN = {w.encode(): i for i, w in enumerate(WORDS)}


def _class_of(b: int) -> int:
    if 0x61 <= b <= 0x7A:
        return 0
    if 0x41 <= b <= 0x5A:
        return 1
    if 0x30 <= b <= 0x39:
        return 2
    if b == 0x20 or 0x09 <= b <= 0x0D:
        return 3
    if b in SYMBOLS:
        return 4
    if b < 0x20 or b == 0x7F:
        return 6
    if b < 0x80:
        return 5
    return 7 if b < 0xE0 else 8 if b < 0xF0 else 9


_CLASS = np.array([_class_of(b) for b in range(256)])
_SPACES = [0x20, *range(0x09, 0x0E)]
_EDGES = b".,;:!?\"'()[]{}#*$%&|<>-"


def measures(data: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Base measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), class counts and common-word counts."""
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = counts.copy()
    points[0x80:0xC0] = 0  # continuation bytes
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[tuple, int] = {}
    last = np.zeros(len(words) + 3, np.int32)
    for i, k in enumerate(zip(words, words[1:], words[2:], strict=False)):
        first = seen.setdefault(k, i)
        if first != i:
            last[first] = last[i] = 1
    covered = last[:-2].copy()
    covered[1:] |= last[:-3]
    covered[2:] |= last[:-4]
    classes = np.bincount(_CLASS, points, minlength=len(CLASSES)).astype(np.int64)
    common = np.zeros(len(WORDS) + 1, np.int64)
    for w in words:
        common[_WORD_BIN.get(w.strip(_EDGES).lower(), -1)] += 1
    base = [len(words), int(points.sum() - counts[_SPACES].sum()), int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), int(covered.sum())]
    return base, classes, common


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches):
    for b in batches:
        found = [measures(x) for x in utf8(b.column(b.num_columns - 1))]
        base = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(BASE))]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], *base, pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int64()))],
            names=[*b.schema.names[:-1], *BASE, "__chars", "__words"],
        )


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of rows of p, each normalised, to each row of q: a matrix."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    m = (p[:, None, :] + q[None, :, :]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=2)
        return np.sqrt(np.maximum(0, (kl(np.broadcast_to(p[:, None, :], m.shape)) + kl(np.broadcast_to(q[None, :, :], m.shape))) / 2))


def _distances(b: pa.RecordBatch, references: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, for the language that is nearest by both distances together: its index and the distances."""
    chars, words = (np.array(b.column(i).to_pylist(), float).reshape(b.num_rows, -1) for i in (b.num_columns - 2, b.num_columns - 1))
    if not len(references["chars"]):
        zero = np.zeros(b.num_rows)
        return zero.astype(int), zero, zero
    at = np.arange(b.num_rows)
    best = (np.zeros(b.num_rows, int), np.full(b.num_rows, np.inf), np.full(b.num_rows, np.inf))
    for first in range(0, len(references["chars"]), REFERENCE_BLOCK):
        c, w = (distance(x, references[k][first : first + REFERENCE_BLOCK]) for x, k in ((chars, "chars"), (words, "words")))
        near = (c + w).argmin(axis=1)
        found = (near + first, c[at, near], w[at, near])
        nearer = found[1] + found[2] < best[1] + best[2]
        best = tuple(np.where(nearer, x, y) for x, y in zip(found, best, strict=True))
    return best


def _judge(batches, held):
    for b in batches:
        _, c, w = _distances(b, held.value)
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(c), pa.array(w)], names=[*b.schema.names[:-2], "char_distance", "word_distance"])


def _references(measured: DataFrame, held=None) -> dict[str, np.ndarray]:
    """Mean histograms of each language's documents; with references, only of documents near one."""
    rows = measured.where("not base_failed and __lang is not null")
    if held is not None:

        def near(batches):
            for b in batches:
                _, c, w = _distances(b, held.value)
                yield b.filter(pa.array((c < REFINE["chars"]) & (w < REFINE["words"])))

        rows = map_texts(rows.select("__lang", "__chars", "__words"), near, rows.select("__lang", "__chars", "__words").schema)
    share = lambda c, i: F.sum(F.get(c, F.lit(i)) / F.greatest(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)))
    sums = [share(F.col("__chars"), i).alias(f"c{i}") for i in range(len(CLASSES))] + [share(F.col("__words"), i).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    top = rows.groupBy("__lang").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= LEAST_DOCS).collect()  # one row a language
    top.sort(key=lambda r: r["__lang"])
    return {k: np.array([[r[f"{k[0]}{i}"] / r["n"] for i in range(n)] for r in top]).reshape(len(top), n) for k, n in (("chars", len(CLASSES)), ("words", len(WORDS) + 1))}


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the base measures, base_failed, the two distances to the nearest language, and kept to every row.

    Null texts count as empty; they have no words and fail the base rule. Rows
    without a language are judged like all others, but make no reference. With
    no reference at all (few or no documents) only the base rule decides.
    Input columns named as the new ones are replaced; the text is not returned.
    """
    new = [*BASE, "base_failed", "char_distance", "word_distance", "kept", "__lang", "__chars", "__words"]
    base = without(docs, *new).withColumn("__lang", F.col(f"`{lang}`").cast("string")).withColumn("__text", F.col(f"`{text}`").cast("string"))
    base = base.select(*[F.col(f"`{c}`") for c in base.columns if c not in (text, "__text")], "__text")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.drop("__text").schema])
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("__chars", T.ArrayType(T.LongType())).add("__words", T.ArrayType(T.LongType()))
    measured = map_texts(base, _measure, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = stored(measured.withColumn("base_failed", failed).select(*schema.names[:-2], "base_failed", "__chars", "__words"), "measures")
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(_references(measured))
    held = sc.broadcast(_references(measured, held))
    schema = T.StructType([f for f in measured.schema if f.name not in ("__chars", "__words")]).add("char_distance", "double").add("word_distance", "double")
    out = map_texts(measured, lambda it: _judge(it, held), schema)
    far = F.lit(False)
    for name, column in (("chars", "char_distance"), ("words", "word_distance")):
        for least, limit in LIMITS[name]:
            far = far | ((F.col("n_words") >= least) & (F.col(column) > limit))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("__lang")


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    found = judge_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "char_distance", "word_distance")
