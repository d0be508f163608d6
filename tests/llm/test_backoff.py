"""Stupid backoff against a plain count of all n-grams."""

import math
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import backoff

SF = "/root/testdata/sf0.001"


def brute(rows):
    docs = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in docs for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def log_s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] > 1:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(0.4) + log_s(gram[1:])

    out = {}
    for i, w in docs:
        n, s = out.get(i, (0, 0.0))
        out[i] = (n + len(w), s + sum(log_s(tuple(w[max(0, k - 2) : k + 1])) for k in range(len(w))))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_words": 500, "part_grams": 50}])
def test_scores(spark, sizes):  # one chunk a task, or many chunks and more parts
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "a b a b a b"), (902, "a b c"), (903, "once"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.log_score) for r in backoff.backoff_scores(df, **sizes).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-6)


@pytest.mark.parametrize("numbers", [[], [0], [0, 255, 256, 7], [1 << 63, (1 << 64) - 1, 0]])
def test_packed(numbers):
    x = np.array(numbers, np.uint64)
    assert backoff.unpacked(backoff.packed(x)).tolist() == numbers


def test_empty(spark):
    assert backoff.backoff_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
