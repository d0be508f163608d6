"""The pipeline's near copies against all pairs of shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pytest
from plumbline.llm import common
from plumbline.llm import near_copies as nc

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(rows):
    """Smallest id of each component over links of 0.8 and more."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(i for i in root if find(i) == i)


@pytest.mark.parametrize("frequent,first,turns,broadcast,small", [(nc.FREQUENT, nc.FIRST, nc.TURNS, common.MOST_BROADCAST, nc.SMALL), (2, 1, 1, 0, 2), (1, 1, 2, 0, 1)])
def test_against_all_pairs(spark, monkeypatch, frequent, first, turns, broadcast, small):
    monkeypatch.setattr(nc, "SMALL", small)
    monkeypatch.setattr(nc, "FREQUENT", frequent)
    monkeypatch.setattr(nc, "FIRST", first)
    monkeypatch.setattr(common, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(nc, "TURNS", turns)
    monkeypatch.setattr(nc, "SAMPLE", 1)
    rng = random.Random(3)
    rows = []
    for family in range(12):  # near copies of one text at many distances, with a foot that all families share
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for copy in range(10):
            own = list(words)
            for at in rng.sample(range(120), copy % 6):
                own[at] = f"x{family}x{copy}x{at}"
            rows.append((len(rows), " ".join(own + ["the", "same", "foot", "on", "every", "single", "page"])))
    rows += [(1000, ""), (1001, "A b"), (1002, "a  B"), (1003, "a b c")]
    got = nc.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = kept(rows)
    assert 20 < len(want) < 110
    assert sorted(r.doc_id for r in got.collect()) == want


def test_blocks_of_all_similar_sets_meet():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 63, 64, 65, 100, 130, 300]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))  # at the very limit of similarity, by leaving out, adding or changing
            rest = rng.permutation(a)[gone:]
            new = rng.integers(0, 1 << 64, int(rng.integers(0, max(0, 5 * len(rest) // 4 - n) + 1)), dtype=np.uint64)
            b = np.unique(np.concatenate([rest, new]))
            both = len(np.intersect1d(a, b))
            similar = 5 * both >= 4 * (len(a) + len(b) - both) and len(b) and not np.array_equal(a, b)
            if similar:
                late = np.sort(nc.blocks(a)[::3])
                assert len(np.intersect1d(nc.blocks(a), nc.blocks(b)))
                assert len(np.intersect1d(nc.blocks(a, frequent=late), nc.blocks(b, frequent=late)))
    few = np.arange(1, 30, dtype=np.uint64)  # all in one class, so that shingles are blocks too
    assert len(np.intersect1d(nc.blocks(few), nc.blocks(np.append(few[1:], np.uint64(50)))))


def test_parities_bound_the_difference(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in (5, 400, 600, 1000, 1100, 5000):
        for share in (0.0, 0.05, 0.2, 0.5):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(share * n / 2) :], rng.integers(0, 1 << 64, int(share * n / 2), dtype=np.uint64)]))
            wide = lambda x: x.tolist() if len(x) > 8 else []
            pa_, pb = nc.parities(a), nc.parities(b)
            both = len(np.intersect1d(a, b))
            rows.append((len(a), nc._folded(pa_).tolist(), wide(pa_), len(b), nc._folded(pb).tolist(), wide(pb), both / (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "na long, oa array<long>, wa array<long>, nb long, ob array<long>, wb array<long>, j double")
    got = [(r.j, r.may) for r in df.select("j", nc._may("a", "b", (4, 5)).alias("may")).collect()]
    assert all(may for j, may in got if j >= 0.8) and not any(may for j, may in got if j < 0.6)


def test_rows(spark):
    df = spark.createDataFrame([(2, "a b", 1), (None, "A b", 2), (1, "a b c", 3), (1, "a b c", 3), (5, None, 4), (4, "", 5)], "doc_id long, text string, x int")
    assert sorted((r.doc_id, r.x) for r in nc.without_near_copies(df).collect()) == [(1, 3), (2, 1), (4, 5)]
    assert nc.without_near_copies(df.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("lang = 'en' and n_chars between 2000 and 4000").orderBy("doc_id").first()
    words = clean.text.split()
    for at in range(10, len(words), len(words) // 8):
        words[at] = "changed"
    assert 0.8 <= jaccard(clean.text, " ".join(words)) < 0.9
    rows = [(9000, clean.text + " first", "en", "s", 1), (9002, " ".join(words), "en", "s", 1), (9003, "few words of its own that nobody else has", "en", "s", 1)]
    out = corpus_pipeline.near_duplicates(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert 9003 in ids and not ids & {9000, 9002}
