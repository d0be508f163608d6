"""Joins on exploded keys: none of their sides may be collected by the driver, however small it is taken for."""

import random

from plumbline.operators import similarity as sim

BITS, LIMIT = 256, 24


def signed(x):
    return [w - (1 << 64) if (w := x >> (64 * k) & (1 << 64) - 1) >> 63 else w for k in range(4)]


def flipped(rng, x, n):
    for at in rng.sample(range(BITS), n):
        x ^= 1 << at
    return x


def test_nearest_rows_are_found_without_a_broadcast_of_exploded_keys(spark):
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(BITS)) for i in range(1, 200)]
    rows += [(1000 + i, flipped(rng, rows[i][1], i % 30)) for i in range(60)]
    queries = [(5000 + i, flipped(rng, rows[i][1], i % 28)) for i in range(150)]
    q, r = (spark.createDataFrame([(i, signed(x)) for i, x in df], "id long, words array<long>") for df in (queries, rows))
    found = sim.nearest_within(q, r, BITS, LIMIT)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    want = {}
    for i, x in queries:
        dist, nearest = min(((x ^ y).bit_count(), j) for j, y in rows)
        if dist <= LIMIT:
            want[i] = ("near" if dist else "exact", dist, nearest)
    assert 100 < len(want) < 150
    assert {x.id: (x.kind, x.dist, x.nearest) for x in found.collect()} == want


def test_close_prints_never_build_on_the_exploded_side(spark, monkeypatch):
    plans, keep = [], sim.stored

    def stored(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(sim, "stored", stored)
    rng = random.Random(5)
    prints = [rng.getrandbits(BITS) for _ in range(40)]
    prints += [flipped(rng, x, 8) for x in prints[:10]]
    df = spark.createDataFrame([(signed(x),) for x in prints], "words array<long>")
    got = {tuple(map(tuple, (x.wa, x.wb))) for x in sim.close_prints(df, BITS, 10).collect()}
    near = [sorted((signed(x), signed(y))) for k, x in enumerate(prints) for y in prints[:k] if (x ^ y).bit_count() <= 10]
    assert len(near) == 10 and got == {tuple(map(tuple, x)) for x in near}
    assert "LeftSemi" in dict(plans)["members"] and "BuildLeft" not in dict(plans)["members"]
