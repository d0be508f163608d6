"""Properties of the evaluation engine's operators on small synthetic tables."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels, text
from plumbline.model import SplitConfig
from plumbline.operators import curves, ensemble, graph, profile, similarity, splits
from plumbline.sources import files


def scored(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")


def naive_bundle(y, s, target=0.01):
    """Per-threshold loops over the same definitions."""
    att, gen = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    points = [(sum(g >= t for g in gen), k, t, sum(a < t for a in att)) for k, t in [(0, 1 + 1e-12), *[(1, t) for t in sorted(set(s))], (2, -1e-12)]]
    points.sort()
    area = sum((q[0] - p[0]) * (q[3] + p[3]) for p, q in zip(points, points[1:], strict=False)) / (2 * len(att) * len(gen))
    at = [p for p in points if p[0] / len(gen) <= target][-1]
    gaps = [abs(p[0] / len(gen) - p[3] / len(att)) for p in points]
    p = points[gaps.index(min(gaps))]
    return area, at[3] / len(att), (p[0] / len(gen) + p[3] / len(att)) / 2


@pytest.mark.parametrize(("kind", "n"), [("uniform", 6), ("uniform", 777), ("ties", 50), ("binary", 50)])
def test_bundle_equals_loops(spark, kind, n):
    rng = np.random.default_rng(123)
    y = rng.integers(0, 2, n)
    y[:2] = 0, 1
    s = {"uniform": rng.random(n), "ties": rng.integers(0, 5, n) / 4, "binary": rng.integers(0, 2, n).astype(float)}[kind]
    r = curves.score_bundle(scored(spark, y, s)).first()
    area, at, eer = naive_bundle(y.tolist(), s.tolist())
    assert (r.audet, r.apcer_at, r.eer) == pytest.approx((area, at, eer), abs=1e-12)
    g, h = 1 - r.audet, 1 - r.apcer_at
    assert r.score == pytest.approx(1 - 2 * g * h / (g + h) if g + h > 0 else 1.0)
    assert 0 <= r.audet <= 1 and 0 <= r.score <= 1


def test_large_curves_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, int(rng.random() < 0.4), float(round(rng.random(), 2))) for k in ("a", "b") for _ in range(400)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "kind string, y int, s double").repartition(5)
    by = [curves.score_bundle(df, ["kind"]), curves.det_curve(df, ["kind"]), curves.score_bundle(df), curves.det_curve(df)]
    plain = [sorted(map(tuple, x.collect()), key=str) for x in by]
    monkeypatch.setattr(curves, "MOST_POINTS", 3)
    by = [curves.score_bundle(df, ["kind"]), curves.det_curve(df, ["kind"]), curves.score_bundle(df), curves.det_curve(df)]
    assert [sorted(map(tuple, x.collect()), key=str) for x in by] == plain


def test_separable_and_inverted(spark):
    s = [*np.linspace(0.01, 0.40, 100), *np.linspace(0.60, 0.99, 100)]
    y = [0] * 100 + [1] * 100
    r = curves.score_bundle(scored(spark, y, s)).first()
    assert r.audet < 0.05 and r.apcer_at < 1e-9 and r.score < 0.05 and r.eer < 1e-6
    assert curves.score_bundle(scored(spark, y, [1 - x for x in s])).first().score > 0.5
    ends = [curves.error_rates_at(scored(spark, y, s), t).first() for t in (2.0, -1.0)]
    assert [(e.apcer, e.bpcer) for e in ends] == [(1.0, 0.0), (0.0, 1.0)]


def test_edges_of_curves(spark):
    with pytest.raises(ValueError):
        curves.validated(spark.createDataFrame([], "y int, s double"))
    with pytest.raises(ValueError):
        curves.validated(spark.createDataFrame([(1, None)], "y int, s double"))
    one = curves.score_bundle(scored(spark, [1, 1], [0.0, 1.0])).first()
    assert one.n == 2 and one.audet is None and one.score is None
    same = curves.score_bundle(scored(spark, [0, 1, 1], [0.5] * 3)).first()
    assert same.audet == pytest.approx(naive_bundle([0, 1, 1], [0.5] * 3)[0])


def test_components_of_paths_and_cliques(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (9, 9), (None, 5), (7, 500), (500, 300)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), 1: 1, 2: 1, 3: 1, 7: 7, 500: 7, 300: 7}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("bits", "words"), [(64, 1), (256, 4)])
def test_band_join_is_complete(spark, bits, words):
    r = random.Random(1)
    prints = [r.getrandbits(bits) for _ in range(200)]
    for i in range(30):
        x = prints[i]
        for _ in range(i % 9):
            x ^= 1 << r.randrange(bits)
        prints.append(x)
    signed = lambda x: [w - (1 << 64) if w >> 63 else w for w in (x >> (64 * k) & (1 << 64) - 1 for k in range(words))]
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "id long, words array<long>")
    got = {(p.a, p.b, p.dist) for p in similarity.near_pairs(df, bits, 8).collect()}
    want = {(i, j, d) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (d := (prints[i] ^ prints[j]).bit_count()) <= 8}
    assert got == want and want


def test_oversized_bucket_raises(spark):
    df = spark.createDataFrame([(i, [i << 40]) for i in range(50)], "id long, words array<long>")
    with pytest.raises(ValueError):
        similarity.near_pairs(df, 64, 3, cap=10).count()


def test_missing_label_is_no_conflict(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    got = {(r.a, r.b): r.label_conflict for r in similarity.label_conflicts(pairs, labels).collect()}
    assert got == {(1, 2): True, (2, 3): False}


def test_splits_are_disjoint_and_even(spark):
    r = random.Random(0)
    rows = [(f"i{t}_{i}", int(r.random() < 0.4), f"C{t}/DL", f"C{t}") for t in range(5) for i in range(200)]
    pairs = [(rows[i][0], rows[i + 1][0]) for t in range(5) for i in range(t * 200, t * 200 + 20, 2)] + [(rows[0][0], rows[201][0])]
    df = spark.createDataFrame(rows, "id string, label int, type string, country string")
    out = splits.build_splits(df, spark.createDataFrame(pairs, "a string, b string"), SplitConfig(n_folds=5)).cache()
    got = {x.id: x for x in out.collect()}
    assert len(got) == 1000 and {x.split for x in got.values()} == {"train", "val", "test"}
    assert all(got[a].split == got[b].split and got[a].cv_fold == got[b].cv_fold for a, b in pairs)
    assert {x.cv_fold for x in got.values() if x.split != "test"} == {0, 1, 2, 3, 4}
    assert all((x.cv_fold == -1) == (x.split == "test") for x in got.values())
    rates = [np.mean([x.label for x in got.values() if x.cv_fold == f]) for f in range(5)]
    assert np.std(rates) < 0.08
    again = splits.build_splits(df, spark.createDataFrame(pairs, "a string, b string"), SplitConfig(n_folds=5))
    assert {x.id: (x.split, x.cv_fold) for x in again.collect()} == {i: (x.split, x.cv_fold) for i, x in got.items()}
    for held, train, _ in splits.iter_type_holdout(out):
        groups = {x.split_group for x in got.values() if x.type == held}
        assert not groups & {x.split_group for x in train.collect()}
    with pytest.raises(AssertionError):
        splits.assert_no_leakage(out.withColumn("split_group", F.lit("g")))


def test_rank_transforms(spark):
    df = spark.createDataFrame([(i, "m", s) for i, s in enumerate([0.1, 0.5, 0.5, 0.9])], "id long, model string, s double")
    assert sorted(r.rank for r in ensemble.tie_ranks(df).collect()) == [0.25, 0.625, 0.625, 1.0]
    assert sorted(r.rank for r in ensemble.position_ranks(df).collect()) == pytest.approx([0, 1 / 3, 2 / 3, 1])
    with pytest.raises(AssertionError):
        ensemble.disjoint(df, df)
    with pytest.raises(ValueError):
        ensemble.aligned(df.select("id", F.lit(1).alias("label")), df.select("id", F.lit(0).alias("label")))


def test_moments_and_imputation(spark):
    x = [1.0, 2.0, 2.5, 9.0, 4.0, 4.5]
    r = profile.moments(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    n, a = len(x), np.array(x)
    z = (a - a.mean()) / a.std()
    g1, g2 = (z**3).mean(), (z**4).mean() - 3
    assert r.skew == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert r.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (float("inf"), None)], "a double, b double")
    assert [tuple(v) for v in profile.imputed(df, ["a", "b"]).collect()] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.0, 0.0)]


def test_kernels_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random(64)
    df = spark.createDataFrame([(x.tolist(),)], "p array<double>")
    d = np.array(kernels.dct_matrix())
    got = df.select(kernels.dct2(F.col("p")).alias("z"), kernels.upsampled_residual(F.col("p")).alias("r"), kernels.tiles(F.col("p")).alias("t")).first()
    g = x.reshape(8, 8)
    assert np.allclose(got.z, (d @ g @ d.T).ravel()) and np.allclose(d @ d.T, np.eye(8))
    assert np.allclose(got.r, (g - g[::2, ::2].repeat(2, 0).repeat(2, 1)).ravel())
    assert np.allclose(got.t, g.reshape(4, 2, 4, 2).mean(axis=(1, 3)).ravel())


def test_text_features(spark):
    df = spark.createDataFrame([("٣١/١٢/١٩٩٩ and 2001-02-30 and 2001-02-28 19991",)], "t string")
    r = df.select(text.dates(text.ascii_digits(F.col("t"))).alias("d"), text.years(F.col("t")).alias("y"), text.is_latin(F.lit("abc")).alias("l"), text.is_latin(F.lit("аbв")).alias("c")).first()
    assert [str(d) for d in r.d] == ["1999-12-31", "2001-02-28"] and r.y == [2001, 2001] and r.l and not r.c


def test_odd_letters_and_chronology(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.odd_letters(F.lit("Röberts Grïffïths Smîth"))) == 4 and one(text.odd_letters(F.lit("Øystein ÖRN Émile"))) == 0
    assert one(text.date_parts(F.lit("31 / 12 /1999 1-2-20001"))) == [(1999, 12, 31), (2000, 2, 1)]
    assert one(text.dates(F.lit("29.02.2001 2035-01-01 1/1/2036 1899-01-01"))) == [datetime.date(2035, 1, 1)]

    def flags(*days):
        found = F.array(*[F.lit(d).cast("date") for d in days]) if days else F.expr("cast(array() as array<date>)")
        return [bool(one(c)) for c in text.chronology(found).values()]

    assert flags() == flags("2015-05-05") == flags("1990-01-01", "2010-01-01") == [False] * 3
    assert flags("2010-01-01", "2015-05-05") == [True, False, True]  # five years apart
    assert flags("1924-01-01", "1990-01-01") == flags("1990-01-01", "2033-01-01") == [False, True, True]
    assert flags("1930-01-01", "2021-01-01") == [True, False, True]
    assert flags("2010-01-01", "1980-01-01") == [False, False, True]  # falls by over 20 years


def test_consistency_vector(spark):
    rows = [
        (1, 0, "Röberts Grïffïths", 0.2, 10.0, None), (1, 1, "12/05/1990", 0.9, 10.0, None), (1, 2, "١٢/٠٥/١٩٩١", 0.4, 20.0, None), (1, 3, "2015-01-01", None, 20.0, "latin"),
        (1, 4, None, 1.0, None, None), (2, 0, "1990 is no date", 1.0, 5.0, "arabic"), (3, 0, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k long, position long, text string, score double, height double, script string")
    got = {r.k: r.asDict() for r in text.consistency_features(df, ("k",), script="script").collect()}
    assert list(got[1])[1:] == list(text.FEATURES) and len(text.FEATURES) == 24
    want = {
        "n_tokens": 4, "total_text_len": 17 + 10 + 10 + 10, "mean_conf": 0.5, "min_conf": 0, "frac_conf_lt30": 0.4, "frac_conf_lt50": 0.6, "std_conf": np.std([0.2, 0.9, 0.4, 0, 1]),
        "n_latin_dates": 2, "n_arabic_date_tokens": 1, "n_valid_dates": 2, "n_distinct_years": 2, "year_span": 25, "chrono_violation": 0, "implausible_age": 0, "future_or_ancient": 0, "n_date_pairs_bad_order": 0,
        "has_dual_script": 1, "crossscript_year_mismatch_frac": 1, "crossscript_any_mismatch": 1, "name_weird_accent_ct": 3, "name_weird_accent_frac": 3 / 16, "n_latin_name_tokens": 1,
        "box_h_cv": 5 / (15 + 1e-6), "box_h_max_over_med": 20 / (15 + 1e-6),
    }
    assert {f: got[1][f] for f in text.FEATURES} == pytest.approx(want)
    assert got[2]["n_arabic_date_tokens"] == 1 and got[2]["has_dual_script"] == 0
    assert all(v == 0 for k, v in got[3].items() if k not in ("k", "frac_conf_lt30", "frac_conf_lt50")) and got[3]["frac_conf_lt30"] == 1


def test_files_and_artifacts(spark, tmp_path):
    for p in ("a/x.JPG", "a/b/x.png", "a/y.jpeg", "a/notes.txt"):
        f = tmp_path / "img" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"123")
    found = files.image_files(spark, str(tmp_path / "img"))
    assert sorted(r.stem for r in found.collect()) == ["x", "x", "y"]
    index = files.file_index(found)
    assert files.path_of(index, "x").endswith("a/x.JPG") and files.path_of(index, "zz") is None
    (tmp_path / "labels.csv").write_text("id,image_path,label,is_digital,type\nx,x.jpg,1,true,FR / PASS / X\nq,q.jpg,0,false,DE\n")
    rows = files.resolved(files.read_labels(spark, str(tmp_path / "labels.csv")), index).orderBy("id").collect()
    assert [(r.id, r.country, r.doc_type, r.path_exists) for r in rows] == [("q", "DE", None, False), ("x", "FR", "PASS / X", True)]
    files.save_json(spark, {"test_frac": 0.2, "other": float("nan"), "n": np.int64(3)}, str(tmp_path / "j"))
    assert files.load_json(spark, str(tmp_path / "j")) == {"test_frac": 0.2, "other": None, "n": 3}
    assert files.load_json(spark, str(tmp_path / "none")) is None
    assert SplitConfig.of(files.load_json(spark, str(tmp_path / "j"))).test_frac == 0.2
    df = spark.createDataFrame([("a", "train", 0), ("b", "test", -1)], "id string, split string, cv_fold int")
    files.save_splits(df, str(tmp_path / "s"), {"n_folds": 3})
    assert files.load_splits(spark, str(tmp_path / "s"), "test").count() == 1 and files.load_config(spark, str(tmp_path / "s")).n_folds == 3
    with pytest.raises(Exception):  # noqa: B017
        files.load_splits(spark, str(tmp_path / "missing"))
    files.save_submission(df.withColumn("label", F.lit(0.5)), str(tmp_path / "sub"))
    assert files.read_submission(spark, str(tmp_path / "sub")).count() == 2
    with pytest.raises(ValueError):
        files.path_labelled(df.select(F.col("id").alias("path")), ("x",), ("y",))
    with pytest.raises(FileNotFoundError):
        files.pick_source(spark, ["a"], lambda p: 0)
