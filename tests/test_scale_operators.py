"""Order statistics by counting, hash-tree fingerprints, numbering, sorted as-of joins and skewed look-ups against plain versions."""

import hashlib
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from medlattice.operators import edc, history, measures, order_stats, release, skew, tables


@pytest.fixture(scope="module")
def values(spark):
    """A group with two thirds of the rows, one of ties only, small ones, null keys and null values."""
    rng = random.Random(5)
    rows = [("hot", rng.random() * 1e6) for _ in range(20_000)] + [("ties", 7.0)] * 4000 + [("ties", 9.0)] * 3999 + [("few", float(i)) for i in range(5)] + [(None, float(i % 50)) for i in range(3000)] + [("hot", None), ("none", None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(7), rows


def plain(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in out.items()}


@pytest.mark.parametrize("large", [100, 5000, 10**9])
def test_ranks_and_quantiles(values, large):
    df, rows = values
    want = plain(rows)
    ranks = {"first": F.lit(0), "middle": F.floor(F.col("n_values") / 2), "last": F.col("n_values") - 1, "beyond": F.col("n_values") + 5}
    got = {r.g: tuple(r)[1:] for r in order_stats.at_ranks(df, ["g"], "v", ranks, large).collect()}
    assert got == {g: (len(v), v[0], v[len(v) // 2], v[-1], None) for g, v in want.items()}
    q = {r.g: (r.a, r.b) for r in order_stats.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.75}, large).collect()}
    own = {r.g: (r.a, r.b) for r in df.where("v is not null").groupBy("g").agg(F.expr("percentile_cont(0.05) within group (order by v)").alias("a"), F.expr("percentile_cont(0.75) within group (order by v)").alias("b")).collect()}
    assert set(q) == set(own) and all(q[g] == pytest.approx(own[g], rel=1e-12) for g in own)
    assert {r.g: r.m for r in measures.upper_medians(df, ["g"], "v", "m", large).collect()} == {g: v[len(v) // 2] for g, v in want.items()}


def test_few_rows_of_a_large_group_are_shuffled(values):
    df, _ = values
    v = df.where("v is not null").select("g", F.col("v").alias("_v"))
    many = v.groupBy("g").agg(F.count("*").alias("n_values")).where("n_values > 3500")
    some = order_stats.stretches(v, ["g"], many, 2, {"m": F.floor(F.col("n_values") / 2)})
    counts = {r.g: r["count"] for r in some.groupBy("g").count().collect()}
    assert 0 < counts["hot"] < 400  # of 20,000
    assert some.where("g = 'ties'").groupBy("_v").count().count() <= 2  # thousands of one value are one row once counted


def test_measures_of_large_groups_are_the_same(values):
    df, _ = values
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    order = ["g", "n_values", "p05", "p95", "low", "high", "mean"]
    assert rows(measures.reference_band(df, ["g"], "v", large=100).select(order)) == rows(measures.reference_band(df, ["g"], "v").select(order))
    odd = df.unionByName(df.limit(3).withColumn("v", F.lit(-1e9)))
    fence = lambda large: sorted((r.g, r.v, round(r.beyond, 3)) for r in measures.iqr_fence(odd, ["g"], "v", large=large).collect() if r.g)
    assert fence(100) == fence(10**9)


def tree(members, block):
    h = sorted({hashlib.sha256(m.encode()).hexdigest() for m in members})
    depth = next(d for d in range(12) if len(h) <= block * 16**d)

    def value(prefix):
        own = [x for x in h if x.startswith(prefix)]
        if len(prefix) == depth:
            return hashlib.sha256("".join(own).encode()).hexdigest()
        kids = [prefix + c for c in "0123456789abcdef" if any(x.startswith(prefix + c) for x in own)]
        return hashlib.sha256("".join(k[-1] + value(k) for k in kids).encode()).hexdigest()

    return len(h), depth, value("")[:16].upper()


def test_tree_fingerprint(spark):
    rows = [("big", f"m{i}") for i in range(900)] + [("small", "a"), ("small", "b"), ("small", "a"), ("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, m string")
    got = {r.g: (r.members, r.depth, r.tree_fingerprint) for r in release.tree_fingerprint(df.repartition(5), ["g"], "m", block=8).collect()}
    assert got["big"] == tree([m for g, m in rows if g == "big"], 8) and got["big"][1] == 2
    assert got["small"] == tree(["a", "b"], 8) and got["none"] == (0, 0, hashlib.sha256(b"").hexdigest()[:16].upper())
    again = {r.g: r.tree_fingerprint for r in release.tree_fingerprint(df.repartition(2, "m"), ["g"], "m", block=8).collect()}
    assert again == {g: v[2] for g, v in got.items()}
    other = df.where("m != 'm17' or m is null").unionByName(spark.createDataFrame([("big", "m17x")], "g string, m string"))
    assert {r.g for r in release.tree_fingerprint(other, ["g"], "m", block=8).collect() if r.tree_fingerprint != again[r.g]} == {"big"}


def test_numbered_and_keys(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    got = tables.numbered(df, ["k"], "place").collect()
    assert [r.place for r in sorted(got, key=lambda r: r.k)] == list(range(1, 5001))
    assert tables.numbered(df.where("false"), ["k"], "place").count() == 0
    keyed = tables.with_keys(df.select("k", F.when(F.col("k") < 10, F.col("k") + 100).alias("key"), F.lit("x").alias("wide")), "key", ["k"]).collect()
    assert sorted(r.key for r in keyed) == sorted([*(r.k + 100 for r in keyed if r.k < 10), *range(110, 110 + sum(r.k >= 10 for r in keyed))])


def test_as_of_over_partition_borders(spark):
    rng = random.Random(3)
    starts = {"hot": sorted(rng.sample(range(10_000), 40)), "one": [500], "late": [9_999]}
    versions = [(k, s, (list(ss[i + 1 :]) or [1_000_000])[0] - 1 if not (k == "hot" and i == 5) else s + 3, f"{k}{i}") for k, ss in starts.items() for i, s in enumerate(ss)]  # one version ends early
    facts = [(i, "hot" if i % 3 else rng.choice(["one", "late", "nobody"]), rng.randrange(12_000), "own") for i in range(6000)] + [(-1, None, 5, "own"), (-2, "hot", None, "own"), (-3, "hot", starts["hot"][7], "own")]
    f = spark.createDataFrame(facts, "id int, k string, at int, extra string").repartition(6)
    v = spark.createDataFrame([*versions, (None, 1, 9, "lost")], "k string, effective_from int, effective_to int, name string")

    def want(k, at):
        mine = [x for x in versions if x[0] == k]
        i = bisect_right([x[1] for x in mine], at) - 1 if at is not None else -1
        return mine[i][3] if mine and i >= 0 and at <= mine[i][2] else None

    first = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = history.as_of_sorted(f.withColumn("day", F.col("at")), v, "k", F.coalesce(F.col("at"), F.lit(-1)), ["name"])
        got = found.collect()
        assert found.columns == ["id", "k", "at", "extra", "day", "name"] and len(got) == len(facts)
        assert {r.id: r.name for r in got} == {i: want(k, at) for i, k, at, _ in facts}
        spread = history.as_of_sorted(f, v, "k", F.col("at"), ["name"]).where("k = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(spread) > 5 and max(r["count"] for r in spread) < 1500  # of 4,000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", first[0])
        spark.conf.set("spark.sql.adaptive.enabled", first[1])


def test_skewed_lookup(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 17 == 1, None).otherwise(F.col("id") % 4000).alias("k"), F.lit("s").alias("s")).repartition(4)
    side = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    keys = skew.frequent(df, ["k"], 0.01).collect()
    assert [r.k for r in keys] == [5]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.lookup(df, side, ["k"], broadcast_rows=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2.2 * sorted(sizes)[len(sizes) // 2]
        got = {r.id: (r.k, r.name) for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 20_000 and all(name == (f"n{k}" if k is not None and k < 3000 else None) for k, name in got.values())
    assert {r.id: (r.k, r.name) for r in skew.lookup(df, side, ["k"]).collect()} == got


def test_acceptance_plan_and_ledger(spark):
    plan = edc.test_cases(spark).collect()
    assert len(plan) == 80 and len({r.test_id for r in plan}) == 80
    assert {r.category: sum(x.category == r.category for x in plan) for r in plan} == {"Form rendering": 8, "Data entry": 32, "Controlled terminology": 11, "Edit check (positive)": 10, "Edit check (negative)": 10, "Visit structure": 5, "Audit trail": 1, "Access control": 1, "Query workflow": 1, "Extract integrity": 1}
    assert all(r.steps and r.expected_result and r.pass_fail == "" for r in plan)
    log = spark.createDataFrame([("Q1", "closed", None), ("Q2", "open", 5), ("Q3", "open", 9), ("Q4", "open", 5), ("Q5", "closed", 2)], "query_id string, status string, age_days int")
    log = log.select("*", *(F.lit("x").alias(c) for c in ("site_id", "subject_id", "check_id", "severity", "query_text")))
    assert [r.query_id for r in edc.query_ledger(log).orderBy("place").collect()] == ["Q3", "Q2", "Q4", "Q5", "Q1"]
