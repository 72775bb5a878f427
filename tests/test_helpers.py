import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from strikeloom.functions import scalar as S
from strikeloom.functions.ordered import average_rank, ewma_scan, order_prefix, ranked, running_sum
from strikeloom.functions.quantiles import array_quantile, exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        key = "hot" if i % 3 else f"k{i % 11}"
        value = 0.0 if rng.random() < 0.35 else rng.choice([-1, 1]) * math.exp(rng.uniform(-8, 8))
        rows.append((i, key, value, rng.randrange(1000)))
    return rows, spark.createDataFrame(rows, "id bigint, k string, v double, t bigint").cache()


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_order_prefix_is_monotone(skewed):
    rows = skewed[1].select("v", order_prefix(F.col("v")).alias("p")).orderBy("v").collect()
    assert all(a["p"] <= b["p"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("descending", [False, True])
def test_ranked(skewed, descending):
    rows, df = skewed
    got = {r["id"]: (r["rank"], r["n"]) for r in ranked(df, ["k"], "v", ["id"], descending, count_out="n").collect()}
    for group in by_key(rows).values():
        order = sorted(group, key=lambda r: (-r[2] if descending else r[2], r[0]))
        assert all(got[r[0]] == (i + 1, len(group)) for i, r in enumerate(order))


def test_average_rank(skewed):
    rows, df = skewed
    got = {r["id"]: r["a"] for r in average_rank(df, ["k"], "v", "a").collect()}
    for group in by_key(rows).values():
        values = sorted(r[2] for r in group)
        for r in group:
            lo, hi = bisect.bisect_left(values, r[2]), bisect.bisect_right(values, r[2])
            assert got[r[0]] == (lo + 1 + hi) / 2


def test_running_sum(skewed):
    rows, df = skewed
    got = {r["id"]: r["s"] for r in running_sum(df, ["k"], ["t", "id"], {"s": F.col("t")}, F.floor(F.col("t") / 100)).collect()}
    for group in by_key(rows).values():
        total = 0
        for r in sorted(group, key=lambda r: (r[3], r[0])):
            total += r[3]
            assert got[r[0]] == total


@pytest.mark.parametrize("rule", ["upper", "nearest", "lower", "linear"])
@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantile_rules(skewed, rule, p):
    rows, df = skewed
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", {"q": (p, rule)}).collect()}
    small = {r["k"]: r["q"] for r in df.groupBy("k").agg(array_quantile(F.collect_list("v"), p, rule).alias("q")).collect()}
    for key, group in by_key(rows).items():
        s, n = sorted(r[2] for r in group), len(group)
        if rule == "upper":
            want = s[min(int(p * n), n - 1)]
        elif rule == "nearest":
            want = s[round(p * (n - 1))]
        elif rule == "lower":
            want = s[int(p * (n - 1))]
        else:
            pos = p * (n - 1)
            lo = int(pos)
            want = s[lo] + (pos - lo) * (s[min(lo + 1, n - 1)] - s[lo])
        assert math.isclose(got[key], want, rel_tol=1e-12, abs_tol=1e-15)
        assert math.isclose(small[key], want, rel_tol=1e-12, abs_tol=1e-15)


def test_upper_median_of_four(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert exact_quantiles(df, [], "v", {"q": (0.5, "upper")}).first()["q"] == 3.0


def test_long_scan_matches_recursion(spark):
    rng = random.Random(3)
    rows, want, y = [], {}, 0.0
    for i in range(3000):
        x, d, start = rng.uniform(-5, 5), rng.choice([0.01, 0.2357, 2.0, 45.0 if i % 500 == 3 else 0.3]), i == 0 or i % 701 == 0
        y = x if start else math.exp(-d) * y + (1 - math.exp(-d)) * x
        rows.append(("a", i, x, d, start))
        want[i] = y
    df = spark.createDataFrame(rows, "k string, t bigint, x double, d double, s boolean")
    got = {r["t"]: r["y"] for r in ewma_scan(df, ["k"], "t", {"y": "x"}, "d", "s").collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-11


def test_scalars(spark):
    texts = ["$41,550.9K", "-$5.8K", "3204.7K+8%", "$12", "n/a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.parse_money("t")).collect()] == pytest.approx([41550900.0, -5800.0, 3204700.0, 12.0, None])
    times = ["2026-09-30T14:30:00Z", "2026-09-30T16:30:00+02:00", "2026-09-30T14:30:00", "1790778600", "never"]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(S.parse_ts("t"))).collect()]
    assert got[:4] == [1790778600] * 4 and got[4] is None
    df = spark.createDataFrame([("SPY", "2026-10-01", "call", 761.0), ("SPY", "2026-10-01", "P", 7.5)], "k string, e string, r string, s double")
    ids = [r[0] for r in df.select(S.contract_id("k", F.col("e").cast("date"), "r", "s")).collect()]
    assert ids == ["SPY261001C00761000", "SPY261001P00007500"]
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.ratio_inf("a", "b")).collect()] == [float("inf"), 0.0, 1.5]
    one = spark.createDataFrame([(2.0, [1.0, 2.0, 3.0, 2.0])], "v double, h array<double>")
    assert one.select(S.percentile_of_history("v", "h")).first()[0] == 0.5


def test_smoothing_keeps_what_lies_far_back(spark):
    """The closed form against the recursion over many blocks, a large value followed by zeros."""
    import math

    from strikeloom.functions.ordered import ewma_scan

    xs = [1e6] + [0.0] * 1100 + [3.0, -2.0] * 450
    df = spark.createDataFrame([("k", i, x, i == 0) for i, x in enumerate(xs)], "key string, i long, x double, first boolean")
    out = ewma_scan(df, ["key"], "i", {"y": "x"}, "0.5D", "first").orderBy("i").collect()
    y, keep = 0.0, math.exp(-0.5)
    for i, (x, row) in enumerate(zip(xs, out)):
        y = x if i == 0 else keep * y + (1 - keep) * x
        assert math.isclose(row["y"], y, rel_tol=1e-9, abs_tol=1e-300), i


def test_contract_ids_stay_apart(spark):
    from pyspark.sql import functions as F

    from strikeloom.functions.scalar import contract_id

    df = spark.createDataFrame([(10_000.0,), (100_000.0,), (12.5,)], "strike double")
    ids = [r[0] for r in df.select(contract_id(F.lit("NKY"), F.lit("2026-01-16").cast("date"), F.lit("C"), "strike")).collect()]
    assert ids == ["NKY260116C10000000", "NKY260116C100000000", "NKY260116C00012500"]
