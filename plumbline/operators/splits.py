"""Group-disjoint, stratified splits and folds, and their leakage checks."""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import md5

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SPLITS, SplitConfig
from ..storage import stored
from .profile import stratum
from .similarity import components, numbered_components

POOL = "pool"


def assign_groups(items: DataFrame, pairs: DataFrame, id_: str = "id") -> DataFrame:
    """Add ``split_group`` from pairs with both ends among the items; single items are groups of their own."""
    ids = items.select(id_)
    kept = pairs.join(ids.select(F.col(id_).alias("a")), "a", "left_semi").join(ids.select(F.col(id_).alias("b")), "b", "left_semi")
    names = numbered_components(components(items, kept, id_), "grp_", 7, id_)
    return items.join(names.withColumnRenamed("name", "split_group"), id_)


def holdout_folds(fraction: float, n_groups: int) -> int:
    """k = max(2, min(round(1 / fraction), groups)), of which one fold is held out; 0 if nothing can be: no fraction or under two groups."""
    return max(2, min(round(1 / fraction), n_groups)) if fraction > 0 and n_groups >= 2 else 0


def fold_count(wanted: int, n_groups: int) -> int:
    """Folds that so many groups allow; 0 for under two."""
    return max(2, min(wanted, n_groups)) if n_groups >= 2 else 0


def split_warnings(n_groups: int, n_pool: int, config: SplitConfig) -> list[str]:
    """What a split of so many groups, and of those outside test, can't do."""
    out = [f"only {n_groups} groups: splits are coarse"] if n_groups < 5 else []
    folds = fold_count(config.n_folds, n_pool)
    if not folds:
        out.append(f"{n_pool} groups outside test: no folds")
    elif folds < config.n_folds:
        out.append(f"only {folds} folds, as there are {n_pool} groups outside test")
    return out


def serpentine_folds(items: DataFrame, k: int, seed: int, group: str = "split_group", strata: Sequence[str] = ("type", "label")) -> DataFrame:
    """Add ``fold``: groups dealt by size within their most frequent stratum, forth and back.

    A group stays whole. The order is (size descending, MD5 of seed and group),
    so the result is the same in any engine, and nothing is collected.
    """
    tagged = items.withColumn("__s", stratum(*strata))
    cells = tagged.groupBy(group, "__s").agg(F.count("*").alias("n"))
    groups = cells.groupBy(group).agg(F.sum("n").alias("size"), F.min_by("__s", F.struct(-F.col("n"), "__s")).alias("__main"))
    order = Window.partitionBy("__main").orderBy(F.desc("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    at = (F.row_number().over(order) - 1).cast("long")
    dealt = groups.withColumn("__at", at)
    place, turn = F.col("__at") % k, F.floor(F.col("__at") / k) % 2
    fold = F.when(turn == 0, place).otherwise(k - 1 - place)
    return items.join(dealt.select(group, fold.cast("int").alias("fold")), group)


def greedy_folds(items: DataFrame, k: int, seed: int, group: str = "split_group", strata: Sequence[str] = ("type", "label")) -> DataFrame:
    """Add ``fold`` by a greedy assignment of groups that keeps each stratum's share even.

    Groups with the same counts per stratum are alike, so Spark first reduces
    the table to distinct count signatures; the driver deals members of each
    signature by number, and ranks map back to groups by a join.
    """
    tagged = items.withColumn("__s", stratum(*strata))
    cells = tagged.groupBy(group, "__s").agg(F.count("*").alias("n"))
    signs = cells.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "__s", "n"))), ";").alias("__sign"), F.sum("n").alias("size"))
    order = Window.partitionBy("__sign").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    ranked = signs.withColumn("__rank", F.row_number().over(order) - 1)
    kinds = signs.groupBy("__sign").agg(F.count("*").alias("members"), F.first("size").alias("size")).collect()  # distinct signatures, few beside groups
    runs = deal_signatures([(r["__sign"], r["members"], r["size"]) for r in kinds], k, seed)
    spark = items.sparkSession
    table = spark.createDataFrame(runs or [("", 0, 0, 0)], "__sign string, lo long, hi long, fold int")
    placed = ranked.join(table, "__sign").where("__rank >= lo and __rank < hi").select(group, "fold")
    return items.join(placed, group)


def deal_signatures(kinds: list[tuple[str, int, int]], k: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(signature, first rank, end rank, fold) runs. Large or one-sided signatures go first, each member to the fold that leaves the strata most even."""
    counts = {s: {c.rpartition("=")[0]: int(c.rpartition("=")[2]) for c in s.split(";")} for s, _, _ in kinds}
    totals: dict[str, int] = defaultdict(int)
    for s, members, _ in kinds:
        for c, n in counts[s].items():
            totals[c] += n * members
    names = sorted(totals)

    def scatter(s: str) -> float:
        v = [counts[s].get(c, 0) for c in names]
        m = sum(v) / len(v)
        return (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5

    have = [dict.fromkeys(names, 0) for _ in range(k)]
    rows = [0] * k
    runs: list[tuple[str, int, int, int]] = []
    for s, members, size in sorted(kinds, key=lambda x: (-scatter(x[0]), md5(f"{seed}:{x[0]}".encode()).hexdigest())):
        at, even = 0, members // k
        for f in range(k if even else 0):  # whole rounds give every fold the same
            runs.append((s, at, at + even, f))
            at += even
            rows[f] += size * even
            for c, n in counts[s].items():
                have[f][c] += n * even
        while at < members:

            def cost(f: int) -> tuple[float, int, int]:
                total = 0.0
                for c in counts[s]:
                    share = [(have[g][c] + (counts[s][c] if g == f else 0)) / totals[c] for g in range(k)]
                    m = sum(share) / k
                    total += sum((x - m) ** 2 for x in share) / k
                return total, rows[f], f

            f = min(range(k), key=cost)
            runs.append((s, at, at + 1, f))
            at += 1
            rows[f] += size
            for c, n in counts[s].items():
                have[f][c] += n
    return runs


def _held(items: DataFrame, fraction: float, n_groups: int, seed: int, strata: Sequence[str]) -> DataFrame:
    """Add ``held``: whether the row is in the first of the folds that make out the fraction; nothing is if there are none."""
    k = holdout_folds(fraction, n_groups)
    if not k:
        return items.withColumn("held", F.lit(False))
    return greedy_folds(items, k, seed, strata=strata).withColumn("held", F.col("fold") == 0).drop("fold")


def build_splits(items: DataFrame, pairs: DataFrame, config: SplitConfig = SplitConfig(), id_: str = "id", strata: Sequence[str] = ("type", "label")) -> DataFrame:
    """Items with split_group, split (train, val, test) and cv_fold (-1 outside train and val); checked for leakage.

    A fraction of 0, or too few groups, leaves a part empty; there are no more
    folds than groups outside test, and none for under two. Both are warned of.
    """
    grouped = stored(assign_groups(items, pairs, id_), "groups")
    n_groups = grouped.select("split_group").distinct().count()
    test = stored(_held(grouped, config.test_frac, n_groups, config.random_state, strata).withColumnRenamed("held", "__test"), "test")
    rest = test.where("not __test")
    n_rest = rest.select("split_group").distinct().count()
    for line in split_warnings(n_groups, n_rest, config):
        warnings.warn(line, stacklevel=2)
    val = _held(rest, config.val_frac / max(1 - config.test_frac, 1e-9), n_rest, config.random_state + 1, strata)
    val = val.select(id_, F.when(F.col("held"), "val").otherwise("train").alias("__part"))
    k = fold_count(config.n_folds, n_rest)
    folds = greedy_folds(rest, k, config.random_state + 2, strata=strata).select(id_, F.col("fold").alias("__fold")) if k else rest.select(id_, F.lit(-1).alias("__fold"))
    out = test.join(val, id_, "left").join(folds, id_, "left")
    out = out.withColumn("split", F.coalesce("__part", F.lit("test"))).withColumn("cv_fold", F.coalesce("__fold", F.lit(-1)))
    out = stored(out.drop("__test", "__part", "__fold"), "splits")
    assert_no_leakage(out, id_)
    return out


def type_holdout(items: DataFrame, seed: int, val_frac: float = 0.15, test_frac: float = 0.15, type_: str = "type", n_folds: int = 5) -> DataFrame:
    """Add ``split`` and ``cv_fold`` by whole types (few): max(1, round) types each for val and test in MD5 order, the others train.

    The types of train and val are dealt to folds by size, the largest first,
    each to the smallest fold so far; there are at most as many folds as types,
    and at least two. Test has fold -1.
    """
    sizes = {r[type_]: r["n"] for r in items.groupBy(type_).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes, key=lambda t: (md5(f"{seed}:{t}".encode()).hexdigest(), t))
    n_val, n_test = max(1, round(len(order) * val_frac)), max(1, round(len(order) * test_frac))
    parts = {t: "val" if i < n_val else "test" if i < n_val + n_test else "train" for i, t in enumerate(order)}
    pool = sorted((t for t in order if parts[t] != "test"), key=lambda t: (-sizes[t], t))
    rows = [0] * max(2, min(n_folds, len(pool)))
    folds = dict.fromkeys(order, -1)
    for t in pool:
        folds[t] = rows.index(min(rows))
        rows[folds[t]] += sizes[t]
    named = items.sparkSession.createDataFrame([(t, parts[t], folds[t]) for t in order], f"{type_} string, split string, cv_fold int")
    return items.join(F.broadcast(named), type_)


def cv_roles(splits: DataFrame, fold: str = "cv_fold") -> DataFrame:
    """(item columns, held_fold, role): every pool item once per fold, as val in its own and train in the others."""
    pool = splits.where(F.col(fold) >= 0)
    held = pool.select(F.col(fold).alias("held_fold")).distinct()
    return pool.join(F.broadcast(held)).withColumn("role", F.when(F.col(fold) == F.col("held_fold"), "val").otherwise("train"))


def iter_cv_folds(splits: DataFrame, fold: str = "cv_fold") -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, train, val) as lazy frames."""
    for r in splits.where(F.col(fold) >= 0).select(fold).distinct().orderBy(fold).collect():
        pool = splits.where(F.col(fold) >= 0)
        yield r[fold], pool.where(F.col(fold) != r[fold]), pool.where(F.col(fold) == r[fold])


def iter_type_holdout(splits: DataFrame, type_: str = "type", group: str = "split_group") -> Iterator[tuple[str, DataFrame, DataFrame]]:
    """(type, train, held): train shares no group with the held type."""
    for r in splits.select(type_).distinct().orderBy(type_).collect():
        held = splits.where(F.col(type_) == r[type_])
        yield r[type_], splits.where(F.col(type_) != r[type_]).join(held.select(group).distinct(), group, "left_anti"), held


def loto_sizes(splits: DataFrame, type_: str = "type", group: str = "split_group") -> DataFrame:
    """(held_type, n_held, n_train, n_tainted) for all types in one job; tainted rows share a group with the held type."""
    pairs = splits.groupBy(group, type_).agg(F.count("*").alias("n"))
    sizes = splits.groupBy(type_).agg(F.count("*").alias("n_held"))
    touched = pairs.select(group, F.col(type_).alias("held_type")).join(pairs, group).where(F.col("held_type") != F.col(type_)).groupBy("held_type").agg(F.sum("n").alias("n_tainted"))
    total = splits.agg(F.count("*").alias("total"))
    out = sizes.withColumnRenamed(type_, "held_type").join(touched, "held_type", "left").join(F.broadcast(total))
    tainted = F.coalesce("n_tainted", F.lit(0))
    return out.select("held_type", "n_held", (F.col("total") - F.col("n_held") - tainted).alias("n_train"), tainted.alias("n_tainted"))


def leak_violations(splits: DataFrame, id_: str = "id", group: str = "split_group") -> DataFrame:
    """(rule, n): repeated ids, groups in several splits, and groups in several folds; all 0 if there is no leakage."""
    ids = splits.groupBy(id_).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("id_unique").alias("rule"), "n")
    by = splits.groupBy(group).agg(F.countDistinct("split").alias("s"), F.countDistinct(F.when(F.col("cv_fold") >= 0, F.col("cv_fold"))).alias("f"))
    groups = by.agg(F.count_if(F.col("s") > 1).alias("s"), F.count_if(F.col("f") > 1).alias("f"))
    both = groups.select(F.inline(F.array(F.struct(F.lit("group_in_one_split").alias("rule"), F.col("s").alias("n")), F.struct(F.lit("group_in_one_fold").alias("rule"), F.col("f").alias("n")))))
    return ids.unionByName(both)


def assert_no_leakage(splits: DataFrame, id_: str = "id", group: str = "split_group") -> None:
    bad = leak_violations(splits, id_, group).where("n > 0").collect()
    if bad:
        raise AssertionError("leakage: " + ", ".join(f"{r['rule']} broken {r['n']} times" for r in bad))


def leaking_pairs(pairs: DataFrame, splits: DataFrame, id_: str = "id") -> DataFrame:
    """Pairs whose ends are in different splits."""
    a = splits.select(F.col(id_).alias("a"), F.col("split").alias("split_a"))
    b = splits.select(F.col(id_).alias("b"), F.col("split").alias("split_b"))
    return pairs.join(a, "a").join(b, "b").where("split_a <> split_b")


def split_stats(splits: DataFrame) -> DataFrame:
    """(split, n, n_fraud, rate, n_types, n_groups, n_countries) for all three splits; empty ones have zeros and a null rate."""
    names = splits.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    got = splits.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_fraud"), F.avg("label").alias("rate"), F.countDistinct("type").alias("n_types"), F.countDistinct("split_group").alias("n_groups"), F.countDistinct("country").alias("n_countries"))
    return F.broadcast(names).join(got, "split", "left").fillna(0, ["n", "n_fraud", "n_types", "n_groups", "n_countries"])


def fold_stats(splits: DataFrame) -> DataFrame:
    """(cv_fold, n_train, n_val, rate, types): sizes against the pool, and the fold's sorted types."""
    pool = splits.where("cv_fold >= 0")
    got = pool.groupBy("cv_fold").agg(F.count("*").alias("n_val"), F.avg("label").alias("rate"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return got.withColumn("n_train", F.sum("n_val").over(Window.partitionBy()) - F.col("n_val"))


def type_splits(splits: DataFrame) -> DataFrame:
    """(type, splits): the splits in which a type appears, in train, val, test order."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    ordered = F.array_sort(F.collect_set(F.struct(rank.alias("r"), "split")))
    return splits.groupBy("type").agg(F.array_join(F.transform(ordered, lambda x: x["split"]), ",").alias("splits"))


def nontrivial_groups(splits: DataFrame, group: str = "split_group") -> DataFrame:
    """One row: groups of several items, and their items."""
    sizes = splits.groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))


def type_overlap(splits: DataFrame, a: str, b: str) -> DataFrame:
    return splits.where(F.col("split") == a).select("type").intersect(splits.where(F.col("split") == b).select("type"))
