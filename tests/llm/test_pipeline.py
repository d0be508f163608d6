"""The pipeline's stages on a small table with planted cases."""

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = docs.where("lang = 'en' and n_chars between 2000 and 4000").orderBy("doc_id").first().text
    rows = [
        (9000, clean + " first", "en", "s", 1),
        (9001, f"{clean} before {item} after", "en", "s", 1),
        (9002, clean.replace("the", "thy") + " write to some.body@example.com now", "en", "s", 1),
        (9003, " ".join(["idiot scum moron"] * 30), "en", "s", 1),
    ]
    now = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), out.schema)
            seen[name] = {r.doc_id: r.text for r in out.collect()}
        now = out
    assert 9003 not in seen["toxicity"] and 9000 in seen["toxicity"]
    texts = seen["decontamination"]
    assert item not in "".join(texts.values())
    assert not any("@example.com" in t for t in seen["personal_data"].values())
    assert now.count() >= len(seen["personal_data"])


def test_whole_run_on_edges(spark):
    """Nulls, empty and long texts, repeated rows, an empty table and columns of clashing names, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(9100, None, None, None, None), (9101, "", "en", "s", 0), (9102, long, "en", "s", 1), (9102, long, "en", "s", 1), (9103, long + " more", "en", "s", 1), (None, "a text without an id " * 3, None, None, None)]
    clashing = ("n_words", "hit_spans", "own", "print", "score", "features", "votes", "goes", "ids", "length", "hash", "id", "key", "fp")
    first = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit("x") for c in clashing})
    now, seen = first, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == first.columns, name
        now = spark.createDataFrame(out.collect(), first.schema)
        seen.append([r.doc_id for r in now.collect()])
        assert all(r[c] == "x" for r in now.collect() for c in clashing)
    toxic, near, bench, pii = seen
    assert toxic.count(9102) == 2 and near.count(9102) == 1 and 9103 not in near and None in near and {9100, 9101} & set(near) == {9100}
    assert sorted(map(str, bench)) == sorted(map(str, pii)) == sorted(map(str, near))
    packed = corpus_pipeline.packing(spark, now, SF).collect()
    assert {p.doc_id for p in packed} == set(pii) and all(len(p.ids) == p.length for p in packed)
    assert sum(p.length for p in packed if p.doc_id == 9102) > 60_000
    empty = first.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in got.collect()}
    assert 0.5 * len(ids) < len(kept) < len(ids) and kept <= ids


def test_cut_spans():
    data = "Ä b, (c) d-e!".encode()
    assert decontaminate.cut_spans(data, [{"start": 1, "end": 3}]) == "Ä ) d-e!".encode()
    assert decontaminate.cut_spans(data, [{"start": 0, "end": 1}, {"start": 3, "end": 5}]) == " b, (c) !".encode()
