"""The query's scores against a count of all n-grams, none left out."""

import math
from collections import Counter

import pytest
from plumbline.llm import backoff

SF = "/root/testdata/sf0.001"


def brute(rows, least):
    docs = {i: (t or "").encode().lower().split() for i, t in rows}
    counts = Counter(tuple(w[i : i + n]) for w in docs.values() for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def log_s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= least:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(0.4) + log_s(gram[1:])

    return {i: (len(w), sum(log_s(tuple(w[max(0, k - 2) : k + 1])) for k in range(len(w)))) for i, w in docs.items()}


def test_query_scores_every_ngram(spark):
    want = brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()], 1)
    got = {r.doc_id: (r.n_words, r.log_score) for r in backoff.op10_stupid_backoff(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i] == (n, pytest.approx(s, abs=2e-6))


@pytest.mark.parametrize("least", [1, 2, 3])
def test_least(spark, least):
    rows = [(1, "a b a b a b c d"), (2, "a b c d e"), (3, "a b c x"), (4, "once"), (5, ""), (6, "y z")]
    got = backoff.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), chunk_words=6, least=least).collect()
    want = brute(rows, least)
    assert {r.doc_id: (r.n_words, pytest.approx(r.log_score, abs=1e-9)) for r in got} == want
