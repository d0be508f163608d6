"""Split edges, reports, sinks and hashing on small tables."""

import warnings

import pytest
from pyspark.sql import functions as F

from plumbline.model import SplitConfig
from plumbline.operators import ensemble, ranking, similarity, splits, validation
from plumbline.sources import files


def items(spark, n, groups=None):
    rows = [(f"i{i}", i % 2, f"T{i % 3}", "C") for i in range(n)]
    pairs = [(f"i{i}", f"i{i + 1}") for i in range(n - 1) if groups and i * groups // n == (i + 1) * groups // n]
    return spark.createDataFrame(rows, "id string, label int, type string, country string"), spark.createDataFrame(pairs, "a string, b string")


def built(spark, n, groups=None, **config):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        out = splits.build_splits(*items(spark, n, groups), SplitConfig(**config))
    return {r.id: r for r in out.collect()}, [str(w.message) for w in said if "group" in str(w.message)]


def test_fractions_of_nothing(spark):
    got, _ = built(spark, 60, test_frac=0.0)
    assert {r.split for r in got.values()} == {"train", "val"} and {r.cv_fold for r in got.values()} == set(range(5))
    got, _ = built(spark, 60, val_frac=0.0)
    assert {r.split for r in got.values()} == {"train", "test"}
    got, _ = built(spark, 60, val_frac=0.0, test_frac=0.0)
    assert {r.split for r in got.values()} == {"train"}


def test_few_groups(spark):
    got, said = built(spark, 40, groups=1)
    assert {(r.split, r.cv_fold) for r in got.values()} == {("train", -1)} and len(said) == 2
    got, said = built(spark, 40, groups=3, test_frac=0.0, val_frac=0.0)
    assert {r.cv_fold for r in got.values()} == {0, 1, 2} and any("only 3 folds" in s for s in said)
    assert splits.holdout_folds(0.15, 100) == 7 and splits.holdout_folds(0.15, 4) == 4 and splits.holdout_folds(0.9, 9) == 2
    assert splits.fold_count(5, 1) == 0 and splits.split_warnings(9, 9, SplitConfig()) == []


def test_type_holdout_folds(spark):
    rows = [(f"{t}{i}", t) for t, n in (("a", 9), ("b", 5), ("c", 4), ("d", 3), ("e", 2), ("f", 1)) for i in range(n)]
    got = splits.type_holdout(spark.createDataFrame(rows, "id string, type string"), 3, n_folds=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.type, set()).add((r.split, r.cv_fold))
    assert all(len(v) == 1 for v in by.values())
    parts = {t: next(iter(v)) for t, v in by.items()}
    assert sorted(p for p, _ in parts.values()) == ["test", "train", "train", "train", "train", "val"]
    assert all((p == "test") == (f == -1) for p, f in parts.values()) and {f for p, f in parts.values() if p != "test"} == {0, 1, 2}


def test_reports(spark):
    rows = [(i, i % 2, f"T{i % 3}", "C", ("val", "train", "train", "test")[i % 4], i % 2 if i % 4 < 3 else -1, i) for i in range(48)]
    table = spark.createDataFrame(rows, "id long, label int, type string, country string, split string, cv_fold int, split_group long")
    scores = table.select("id", (F.col("label") * 0.5 + F.col("id") / 100).alias("s"))
    got = {(r.split, r.type): r for r in validation.holdout_report(table, scores, ("val", "none")).collect()}
    assert got["none", validation.WHOLE].note == "empty" and got["none", validation.WHOLE].n == 0
    assert got["val", validation.WHOLE].note is not None  # all of val have label 0
    folds = table.where("cv_fold >= 0").select("id", "cv_fold").join(scores, "id")
    report = {r.fold: r for r in validation.cv_report(table.withColumn("label", F.floor(F.col("id") / 4).cast("int") % 2), folds).collect()}
    assert report[0].n_val + report[0].n_train == 36 and report[0].val_types == "T0,T1,T2" and report[1].score is not None
    for broken in (folds.where("id <> 2"), folds.unionAll(folds.where("id = 2")), folds.withColumn("id", F.when(F.col("id") == 2, 99).otherwise(F.col("id")))):
        with pytest.raises(ValueError):
            validation.cv_report(table, broken)
    with pytest.raises(AssertionError):
        validation.sanity_report(table.withColumn("split_group", F.lit(1)), spark.createDataFrame([], "a long, b long"))
    sane = {(r.section, r.key): r.value for r in validation.sanity_report(table, spark.createDataFrame([(0, 1), (0, 4)], "a long, b long")).collect()}
    assert sane["duplicates", "leaking"] == 1 and sane["type_overlap.train_val", "T1"] == 1 and sane["groups", "n_groups"] == 48


def test_numbers_by_range(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([(None, 1), ("a", 3), ("a", 3), ("b", None), ("a", 1), (None, 0), ("a", 2)])]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(3)
    got = {r.i: (r.place, r.n) for r in ranking.numbered(df, ["v", "i"], ["k"], total="n").collect()}
    assert got == {0: (1, 2), 5: (0, 2), 4: (0, 4), 6: (1, 4), 1: (2, 4), 2: (3, 4), 3: (0, 1)}
    assert ranking.numbered(df.limit(0), ["v"]).count() == 0
    big = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    assert all(r.x == r.place for r in ranking.numbered(big, ["x"]).collect())


def test_digest_counts_equal_rows(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25), (2, 0.25)], "id long, s double")
    of = lambda df: tuple(ensemble.keyed_digest(df).first())
    assert of(a) == of(a.orderBy(F.desc("id")).repartition(2)) and of(a) != of(a.limit(1)) and of(a) != of(a.distinct())
    assert of(a.limit(0))[0] == 0


def test_files_that_fail_are_counted(spark):
    df = spark.createDataFrame([(1, b"one two three"), (2, b"\xff\xfe"), (3, None), (4, b"ONE two three")], "id long, content binary")
    hashes = similarity.hashed(df)
    assert tuple(similarity.hash_counts(hashes).first()) == (2, 2)
    got = {r.id: r for r in similarity.readable(hashes).collect()}
    assert set(got) == {1, 4} and got[1].words == got[4].words and got[1].md5 != got[4].md5


def test_sinks_and_sources(spark, tmp_path):
    img = tmp_path / "img"
    (img / "sub").mkdir(parents=True)
    for name in ("b.png", "a.jpg", "sub/c.jpeg", "x.txt"):
        (img / name).write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in files.image_list(spark, str(img)).collect()] == ["a.jpg", "b.png", "c.jpeg"]
    assert [r.stem for r in files.image_list(spark, str(img), 1, recursive=False).collect()] == ["a"]
    df = spark.createDataFrame([("a", "train", 1, [0.5]), ("b", "test", 0, [1.5]), ("c", "val", 0, [2.5])], "id string, split string, cv_fold int, x array<double>")
    files.save_features(df, str(tmp_path / "f"))
    assert sorted(spark.read.parquet(str(tmp_path / "f")).collect()) == sorted(df.collect())
    files.save_splits(df.drop("x"), str(tmp_path / "s"))
    for name in ("train", "val", "test"):
        assert [r.split for r in spark.read.option("header", True).csv(str(tmp_path / "s" / f"{name}.csv")).collect()] == [name]
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "all.csv")).count() == 3
    for _ in range(2):
        files.append_rows(df.select("id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    for i, text in enumerate(('{"run": "a", "score": 1.0}', "{broken", '{"run": "b", "score": 2.0}')):
        (tmp_path / "runs" / str(i)).mkdir(parents=True)
        (tmp_path / "runs" / str(i) / "results.json").write_text(text)
    found = files.results(spark, str(tmp_path / "runs/*/results.json"), "run string, score double").where("run is not null")
    assert sorted(r.run for r in found.collect()) == ["a", "b"]
    assert files.pick_source(spark, ["x", "y", "z"], {"x": 0, "y": 3, "z": 3}.get) == "y"
    assert files.optional_columns(df, ["split", "none", "id"]).columns == ["split", "id"]
    assert [r.id for r in files.first_per_key(df, "split", "id").orderBy("id").collect()] == ["a", "b", "c"]
