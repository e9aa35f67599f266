import random

from pyspark.sql import functions as F

from tallyloom.operators import ordered as O


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, "hot" if i % 3 else f"g{i % 7}", rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(5)
    got = O.totals_by_key(df, {"before": F.col("v"), "at": F.lit(1)}, "k", ["g"], width=16).collect()
    seen = {}
    expected = {}
    for k, g, v in sorted(rows):
        total, n = seen.get(g, (0, 0))
        expected[k] = (total, n)
        seen[g] = (total + v, n + 1)
    assert {r["k"]: (r["before"], r["at"]) for r in got} == expected


def test_totals_by_sort_with_a_hot_value(spark):
    rows = [(i, 5 if i % 3 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = O.totals_by_sort(df, {"at": F.lit(1)}, [F.col("v"), F.col("k")]).collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r["k"]: r["at"] for r in got} == {k: i for i, (k, _) in enumerate(order)}


def test_carry_forward_across_chunks(spark):
    rows = [(i, "f", "s%d" % i if i in (3, 40, 41, 90) else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, g string, v string").repartition(3)
    got = {r["k"]: r["out"] for r in O.carry_forward(df, "v", "k", ["g"], "out", width=8).collect()}
    last = None
    for k, _, v in rows:
        last = v or last
        assert got[k] == last


def test_trailing_mean_across_chunks(spark):
    rng = random.Random(2)
    for n in (4, 60):
        values = [rng.random() for _ in range(n)]
        df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)], "p long, g string, v double")
        got = O.trailing_mean(df, "v", "p", ["g"], 5, "m", width=7).collect()
        assert len(got) == n
        for r in got:
            p = r["p"]
            want = values[p] if p < 4 else sum(values[p - 4 : p + 1]) / 5
            assert abs(r["m"] - want) < 1e-12


def test_keys_with_wide_gaps_are_sorted_into_ranges(spark):
    rows = [((i * 7919 % 101) << 52, "hot" if i % 3 else "cold", i % 5) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(4)
    got = O.totals_by_key(df, {"before": F.col("v")}, "k", ["g"]).collect()
    seen, expected = {}, {}
    for k, g, v in sorted(rows):
        expected[k] = seen.get(g, 0)
        seen[g] = expected[k] + v
    assert {r["k"]: r["before"] for r in got} == expected
