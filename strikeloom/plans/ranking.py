"""Cross-sectional ranks, scores, truth sets and precision."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.constants import SCORE_FEATURES, UNUSUAL_FEATURES
from strikeloom.functions.scalar import ratio
from strikeloom.operators import contracts, ranking
from strikeloom.plans.common import d, n, r
from strikeloom.plans.contracts import features
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize, table

view("ranks_long", " UNION ALL ".join(
    f"SELECT day, underlying, '{c}' AS feature, CASE WHEN count(*) OVER (PARTITION BY day) > 1 THEN (row_number() OVER (PARTITION BY day ORDER BY {c}, underlying) - 1) "
    f"/ (count(*) OVER (PARTITION BY day) - 1)::DOUBLE ELSE 0.5::DOUBLE END AS pct FROM tfeat WHERE {c} IS NOT NULL"
    for c in SCORE_FEATURES))
view("scores", "SELECT day, underlying, avg(pct) AS score, count(pct) AS score_n FROM ranks_long GROUP BY ALL")
view("unusual", f"SELECT day, underlying, avg(pct) AS unusual FROM ranks_long WHERE feature IN ({', '.join(repr(c) for c in UNUSUAL_FEATURES)}) GROUP BY ALL")


@query("win_11_section_rank", """
SELECT strftime(day, '%Y-%m-%d') AS day, underlying, feature, round(pct, 6) AS pct FROM ranks_long""")
def section_rank(spark, sf):
    return ranking.section_ranks(features(spark, sf), SCORE_FEATURES).select(
        d("day").alias("day"), "underlying", "feature", r("pct").alias("pct"))


@query("top_4_composite_score", """
SELECT strftime(day, '%Y-%m-%d') AS day, underlying, round(score, 6) AS score, score_n FROM scores""")
def composite(spark, sf):
    return ranking.composite(features(spark, sf)).select(
        d("day").alias("day"), "underlying", r("score").alias("score"), "score_n")


view("fsum", """
SELECT underlying, day, count(*) AS n_contracts, sum(premium) AS premium, CAST(sum(volume) AS BIGINT) AS volume, sum(ask_volume) AS ask,
  sum(bid_volume) AS bid, sum(mid_volume) AS mid, coalesce(max(CASE WHEN NOT isinf(rvol) THEN rvol END), 0) AS rvol_max,
  count(*) FILTER (flag_rvol) AS n_flag_rvol, count(*) FILTER (flag_oi) AS n_flag_oi,
  coalesce(max(CASE WHEN flag_oi THEN abs(oi_change) END), 0) AS oi_max, sum(abs(oi_change)) AS oi_abs_sum, max(pctile) AS pctile_max
FROM flags GROUP BY underlying, day""")
_ORDERS = {
    "rvol": "n_flag_rvol DESC, rvol_max DESC, premium DESC, underlying",
    "oi": "n_flag_oi DESC, oi_max DESC, premium DESC, underlying",
    "union": "n_flag_rvol + n_flag_oi DESC, rvol_max + oi_max DESC, premium DESC, underlying",
    "surprise": "coalesce(pctile_max, -1) DESC, premium DESC, underlying",
    "premium": "premium DESC, underlying",
}
view("tranks", " UNION ALL ".join(
    f"SELECT '{k}' AS ranking, day, underlying, row_number() OVER (PARTITION BY day ORDER BY {o}) AS rank FROM fsum" for k, o in _ORDERS.items()))


def summary(spark, sf):
    return ranking.flag_summary(contracts.activity(adapters.contract_day(spark, sf)))


@query("top_3_ticker_ranks", """
SELECT ranking, strftime(day, '%Y-%m-%d') AS day, underlying, rank FROM tranks""")
def ticker_ranks(spark, sf):
    return ranking.ticker_ranks(summary(spark, sf)).select("ranking", d("day").alias("day"), "underlying", n("rank").alias("rank"))


_RICH = ("premium", "volume", "n_contracts", "ask_share_all", "rvol_max", "n_flag_rvol", "n_flag_oi", "oi_abs_sum", "prem_pctile")
view("rich_base", """
SELECT f.*, ask / nullif(ask + bid + mid, 0)::DOUBLE AS ask_share_all, t.prem_pctile FROM fsum f JOIN (
  SELECT a.underlying, a.day, (count(*) FILTER (b.premium < a.premium) + 0.5::DOUBLE * count(*) FILTER (b.premium = a.premium)) / nullif(count(b.underlying), 0) AS prem_pctile
  FROM tday_n a LEFT JOIN tday_n b ON a.underlying = b.underlying AND b.rn < a.rn AND a.rn - b.rn <= 20 GROUP BY a.underlying, a.day) t USING (underlying, day)""")
view("rich_long", " UNION ALL ".join(
    f"SELECT day, underlying, '{c}' AS feature, CASE WHEN count(*) OVER (PARTITION BY day) > 1 THEN (row_number() OVER (PARTITION BY day ORDER BY {c}, underlying) - 1) "
    f"/ (count(*) OVER (PARTITION BY day) - 1)::DOUBLE ELSE 0.5::DOUBLE END AS pct FROM rich_base WHERE {c} IS NOT NULL"
    for c in _RICH))


def rich(spark, sf):
    days = materialize(adapters.contract_day(spark, sf), "contract-days")
    surprise = ranking.ticker_surprise(ranking.ticker_day(days)).select("underlying", "day", "prem_pctile")
    total = F.col("ask") + F.col("bid") + F.col("mid")
    s = ranking.flag_summary(contracts.activity(days))
    return s.join(surprise, ["underlying", "day"]).withColumn("ask_share_all", F.try_divide(F.col("ask"), total))


@query("top_5_rich_scores", """
SELECT strftime(day, '%Y-%m-%d') AS day, underlying, round(0.5 * max(CASE WHEN feature = 'n_flag_rvol' THEN pct END) + 0.5 * max(CASE WHEN feature = 'n_flag_oi' THEN pct END), 6) AS score_flags,
  round(any_value(prem_pctile), 6) AS score_surprise, round(avg(pct), 6) AS score_rich
FROM rich_long JOIN (SELECT day, underlying, prem_pctile FROM rich_base) USING (day, underlying) GROUP BY day, underlying""")
def rich_scores(spark, sf):
    base = materialize(rich(spark, sf), "rich")
    long = ranking.section_ranks(base, _RICH)
    pick = lambda c: F.coalesce(F.max(F.when(F.col("feature") == c, F.col("pct"))), F.lit(0.5))
    s = long.groupBy("day", "underlying").agg(
        (0.5 * pick("n_flag_rvol") + 0.5 * pick("n_flag_oi")).alias("score_flags"), F.avg("pct").alias("score_rich"))
    return s.join(base.select("day", "underlying", "prem_pctile"), ["day", "underlying"]).select(
        d("day").alias("day"), "underlying", r("score_flags").alias("score_flags"),
        r("prem_pctile").alias("score_surprise"), r("score_rich").alias("score_rich"))


# Truth lists: the same screens with other parameters.
view("truth_vol", "SELECT DISTINCT day, underlying FROM flags WHERE base_obs >= 3 AND rvol >= 1.5 AND NOT isinf(rvol)")
view("truth_oi", "SELECT DISTINCT day, underlying FROM flags WHERE abs(oi_change) >= 200")
view("truth_prem", "SELECT day, underlying, total FROM (SELECT day, underlying, sum(premium + size) AS total, row_number() OVER (PARTITION BY day ORDER BY sum(premium + size) DESC, underlying) AS rk FROM prints GROUP BY day, underlying) WHERE rk <= 10")


def truths(spark, sf, flags):
    vol = flags.where((F.col("base_obs") >= 3) & (F.col("rvol") >= 1.5) & (F.col("rvol") != float("inf"))).select("day", "underlying").distinct()
    oi = flags.where(F.abs("oi_change") >= 200).select("day", "underlying").distinct()
    totals = adapters.prints(spark, sf).groupBy("day", "underlying").agg(F.sum(F.col("premium") + F.col("size")).alias("total"))
    ranks = ranking.ranked(totals, ["day"], "total", ["underlying"], descending=True)
    return vol, oi, ranks.where("rank <= 10").select("day", "underlying", "total")


@query("top_6_precision_at_k", """
SELECT strftime(r.day, '%Y-%m-%d') AS day, count(*) FILTER (rank <= 5) AS n_5, count(*) FILTER (rank <= 5 AND t.underlying IS NOT NULL) AS hits_5,
  count(*) FILTER (rank <= 10) AS n_10, count(*) FILTER (rank <= 10 AND t.underlying IS NOT NULL) AS hits_10, any_value(z.n) AS n_truth,
  round(count(*) FILTER (rank <= 5 AND t.underlying IS NOT NULL) / count(*) FILTER (rank <= 5)::DOUBLE, 6) AS precision_5,
  round(count(*) FILTER (rank <= 10 AND t.underlying IS NOT NULL) / any_value(z.n)::DOUBLE, 6) AS recall_10
FROM tranks r LEFT JOIN truth_vol t ON r.day = t.day AND r.underlying = t.underlying
LEFT JOIN (SELECT day, count(*) AS n FROM truth_vol GROUP BY day) z ON r.day = z.day WHERE r.ranking = 'union' GROUP BY r.day""")
def precision(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, _, _ = truths(spark, sf, flags)
    p = ranking.precision_at(ranking.ticker_rank(ranking.flag_summary(flags), "union"), vol, (5, 10))
    return p.select(d("day").alias("day"), "n_5", "hits_5", "n_10", "hits_10", "n_truth", r("precision_5").alias("precision_5"),
                    r("recall_10").alias("recall_10"))


@query("top_6_contract_set_precision", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (p) AS n_pred, count(*) FILTER (q) AS n_truth, count(*) FILTER (p AND q) AS hits,
  round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0)::DOUBLE, 6) AS recall
FROM (SELECT day, occ, flag_rvol OR flag_oi AS p, (base_obs >= 3 AND rvol >= 1.5 AND NOT isinf(rvol)) OR abs(oi_change) >= 200 AS q FROM flags)
WHERE p OR q GROUP BY day""")
def set_precision(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    pred = flags.where("flag_rvol or flag_oi")
    truth = flags.where(((F.col("base_obs") >= 3) & (F.col("rvol") >= 1.5) & (F.col("rvol") != float("inf"))) | (F.abs("oi_change") >= 200))
    return ranking.set_precision(pred, truth, ["day"], "occ").select(
        d("day").alias("day"), "n_pred", "n_truth", "hits", r("precision").alias("precision"), r("recall").alias("recall"))


@query("jn_8_truth_membership", """
SELECT strftime(f.day, '%Y-%m-%d') AS day, f.underlying, t.underlying IS NOT NULL AS hit, o.underlying IS NOT NULL AS hit_oi
FROM fsum f LEFT JOIN truth_vol t USING (day, underlying) LEFT JOIN truth_oi o USING (day, underlying)""")
def membership(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, oi, _ = truths(spark, sf, flags)
    s = ranking.flag_summary(flags).select("day", "underlying")
    out = s.join(vol.withColumn("_v", F.lit(True)), ["day", "underlying"], "left").join(
        oi.withColumn("_o", F.lit(True)), ["day", "underlying"], "left")
    return out.select(d("day").alias("day"), "underlying", F.coalesce("_v", F.lit(False)).alias("hit"),
                      F.coalesce("_o", F.lit(False)).alias("hit_oi"))


@query("top_7_score_variants", """
SELECT strftime(day, '%Y-%m-%d') AS day, underlying, round(blend, 6) AS blend, prem_rank,
  band * 5 + row_number() OVER (PARTITION BY day, band ORDER BY round(coalesce(unusual, -1), 9) DESC, prem_rank) AS band_rank FROM (
  SELECT *, (prem_rank - 1) // 5 AS band FROM (
    SELECT p.day, p.underlying, u.unusual, 0.5 * p.pct + 0.5 * coalesce(u.unusual, 0) AS blend,
      row_number() OVER (PARTITION BY p.day ORDER BY p.pct DESC, p.underlying) AS prem_rank
    FROM ranks_long p LEFT JOIN unusual u USING (day, underlying) WHERE p.feature = 'premium'))""")
def variants(spark, sf):
    long = materialize(ranking.section_ranks(features(spark, sf), SCORE_FEATURES), "ranks")
    odd = F.col("feature").isin(*UNUSUAL_FEATURES)
    rows = long.groupBy("day", "underlying").agg(
        F.max(F.when(F.col("feature") == "premium", F.col("pct"))).alias("prem"), F.avg(F.when(odd, F.col("pct"))).alias("unusual"))
    rows = rows.withColumn("blend", 0.5 * F.col("prem") + 0.5 * F.coalesce("unusual", F.lit(0.0)))
    out = ranking.banded_rank(rows, ["day"], "prem", "unusual")
    return out.select(d("day").alias("day"), "underlying", r("blend").alias("blend"), n("outer_rank").alias("prem_rank"),
                      n("rank").alias("band_rank"))


view("attention", "SELECT day, underlying FROM truth_prem UNION SELECT day, underlying FROM truth_vol UNION SELECT day, underlying FROM truth_oi")


@query("set_1_attention_union", "SELECT strftime(day, '%Y-%m-%d') AS day, underlying FROM attention")
def attention(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, oi, prem = truths(spark, sf, flags)
    both = prem.select("day", "underlying").unionByName(vol).unionByName(oi).distinct()
    return both.select(d("day").alias("day"), "underlying")


@query("set_2_universe", """
SELECT underlying, min(provenance) AS provenance FROM (
  SELECT underlying, '1_traded_' || strftime(max(day), '%Y-%m-%d') AS provenance FROM prints
  WHERE day IN (SELECT day FROM (SELECT DISTINCT day FROM prints) WHERE day >= (SELECT max(day) FROM prints) - 12 ORDER BY day DESC LIMIT 5) GROUP BY underlying
  UNION ALL SELECT 'T' || (c_custkey % 40)::VARCHAR, '2_tier_' || min(CASE WHEN c_nationkey % 2 = 0 THEN 'T0' ELSE 'T1' END) FROM customer WHERE c_nationkey < 10 GROUP BY ALL)
GROUP BY underlying""")
def universe(spark, sf):
    from strikeloom.operators import sets
    cu = table(spark, sf, "customer")
    tiers = cu.where("c_nationkey < 10").select(
        F.concat(F.lit("T"), (F.col("c_custkey") % 40).cast("string")).alias("underlying"),
        F.when(F.col("c_nationkey") % 2 == 0, "T0").otherwise("T1").alias("tier"))
    return sets.universe(adapters.prints(spark, sf), tiers)


@query("set_3_common_tickers", """
SELECT strftime(day, '%Y-%m-%d') AS day, underlying FROM (SELECT day, underlying FROM truth_vol INTERSECT SELECT day, underlying FROM truth_oi)""")
def common(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, oi, _ = truths(spark, sf, flags)
    return vol.intersect(oi).select(d("day").alias("day"), "underlying")


@query("set_4_differences", """
SELECT 'only_volume' AS side, strftime(day, '%Y-%m-%d') AS day, underlying FROM (SELECT day, underlying FROM truth_vol EXCEPT SELECT day, underlying FROM truth_oi)
UNION ALL SELECT 'only_oi', strftime(day, '%Y-%m-%d'), underlying FROM (SELECT day, underlying FROM truth_oi EXCEPT SELECT day, underlying FROM truth_vol)""")
def differences(spark, sf):
    from strikeloom.operators import sets
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, oi, _ = truths(spark, sf, flags)
    return sets.differences(vol, oi, ["day", "underlying"], "only_volume", "only_oi").select(
        "side", d("day").alias("day"), "underlying")


@query("fit_2_spearman_pearson", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(coalesce(corr(ra, rb), 0), 6) + 0.0 AS spearman, round(coalesce(corr(premium, volume), 0), 6) + 0.0 AS pearson FROM (
  SELECT day, premium, volume, rank() OVER (PARTITION BY day ORDER BY premium) + (count(*) OVER (PARTITION BY day, premium) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY day ORDER BY volume) + (count(*) OVER (PARTITION BY day, volume) - 1) / 2.0::DOUBLE AS rb FROM cday) GROUP BY day""")
def spearman(spark, sf):
    days = adapters.contract_day(spark, sf).select("day", "premium", F.col("volume").cast("double").alias("volume"))
    return ranking.spearman(materialize(days, "days"), ["day"], "premium", "volume").select(
        d("day").alias("day"), "n", r("spearman").alias("spearman"), r("pearson").alias("pearson"))


@query("fit_21_rank_validation", """
SELECT strftime(s.day, '%Y-%m-%d') AS day, count(*) FILTER (rk <= 10 AND p.underlying IS NOT NULL) AS hits_prem,
  count(*) FILTER (rk <= 10 AND u.underlying IS NOT NULL) AS hits_unusual, count(*) FILTER (rk <= 10 AND a.underlying IS NOT NULL) AS hits_attention
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, underlying) AS rk FROM scores) s
LEFT JOIN truth_prem p USING (day, underlying) LEFT JOIN (SELECT * FROM truth_vol UNION SELECT * FROM truth_oi) u USING (day, underlying)
LEFT JOIN attention a USING (day, underlying) GROUP BY s.day""")
def rank_validation(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, oi, prem = truths(spark, sf, flags)
    ranks = materialize(ranking.ranked(ranking.composite(features(spark, sf)).withColumn("score", F.round("score", 9)), ["day"], "score", ["underlying"], descending=True), "ranks")
    unusual = vol.unionByName(oi).distinct()
    out = None
    for name, truth in (("prem", prem), ("unusual", unusual), ("attention", prem.select("day", "underlying").unionByName(unusual))):
        one = ranking.precision_at(ranks, truth, (10,)).select("day", F.col("hits_10").alias(f"hits_{name}"))
        out = one if out is None else out.join(one, "day", "full")
    return out.select(d("day").alias("day"), "hits_prem", "hits_unusual", "hits_attention")


_KS = (10, 25, 50, 100, 150)


view("scored", """
SELECT t.day, t.underlying, t.premium, s.score, p.total FROM tfeat t LEFT JOIN (SELECT day, underlying, round_even(score, 9) AS score FROM scores) s USING (day, underlying)
LEFT JOIN (SELECT day, underlying, sum(premium + size) AS total FROM prints GROUP BY ALL) p USING (day, underlying)""")
view("measured", """
SELECT 'score' AS ranking, day, underlying, score AS x, total, row_number() OVER (PARTITION BY day ORDER BY score DESC, underlying) AS rank FROM scored WHERE score IS NOT NULL
UNION ALL SELECT 'premium', day, underlying, premium, total, row_number() OVER (PARTITION BY day ORDER BY premium DESC, underlying) FROM scored WHERE premium IS NOT NULL""")
view("truth_sets", """
SELECT 'prem' AS truth, day, underlying FROM truth_prem UNION ALL SELECT 'unusual', day, underlying FROM (SELECT * FROM truth_vol UNION SELECT * FROM truth_oi)
UNION ALL SELECT 'attention', day, underlying FROM attention""")


@query("fit_21_rank_measures", f"""
SELECT strftime(m.day, '%Y-%m-%d') AS day, m.ranking, t.truth, k, count(*) AS n, count(w.underlying) AS hits, round(count(w.underlying) / count(*)::DOUBLE, 6) AS precision,
  round(count(w.underlying) / any_value(z.n)::DOUBLE, 6) AS recall, NULL::DOUBLE AS spearman
FROM measured m CROSS JOIN (VALUES ('prem'), ('unusual'), ('attention')) t(truth) JOIN (SELECT unnest({list(_KS)}) AS k) ON m.rank <= k
LEFT JOIN truth_sets w ON w.truth = t.truth AND w.day = m.day AND w.underlying = m.underlying
LEFT JOIN (SELECT truth, day, count(*) AS n FROM truth_sets GROUP BY ALL) z ON z.truth = t.truth AND z.day = m.day GROUP BY m.day, m.ranking, t.truth, k
UNION ALL SELECT strftime(day, '%Y-%m-%d'), ranking, NULL, 0, count(*), NULL, NULL, NULL, round(CASE WHEN count(*) >= 3 THEN coalesce(corr(ra, rb), 0) ELSE 0 END, 6) + 0.0 FROM (
  SELECT *, rank() OVER (PARTITION BY ranking, day ORDER BY x) + (count(*) OVER (PARTITION BY ranking, day, x) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY ranking, day ORDER BY total) + (count(*) OVER (PARTITION BY ranking, day, total) - 1) / 2.0::DOUBLE AS rb FROM measured WHERE total IS NOT NULL) GROUP BY ranking, day""")
def rank_measures(spark, sf):
    """Hits, precision and recall of the ranks by score and by premium at several k, and both rank correlations with the day's total.

    ``truth`` is null and ``k`` 0 in the rows of the correlations.
    """
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol, oi, prem = truths(spark, sf, flags)
    f = materialize(features(spark, sf), "features")
    scores = ranking.composite(f).select("day", "underlying", F.round("score", 9).alias("score"))
    scored = materialize(f.select("day", "underlying", F.col("premium").cast("double").alias("premium")).join(scores, ["day", "underlying"], "left"), "scored")
    totals = adapters.prints(spark, sf).groupBy("day", "underlying").agg(F.sum(F.col("premium") + F.col("size")).cast("double").alias("total"))
    unusual = vol.unionByName(oi).distinct()
    sets_of = {"prem": prem.select("day", "underlying"), "unusual": unusual, "attention": prem.select("day", "underlying").unionByName(unusual).distinct()}
    out = None
    for by in ("score", "premium"):
        ranks = materialize(ranking.ranked(scored.where(F.col(by).isNotNull()), ["day"], by, ["underlying"], descending=True), "ranks")
        for name, truth in sets_of.items():
            at = [F.struct(F.lit(k).alias("k"), *[F.col(f"{c}_{k}").cast(t).alias(c) for c, t in (("n", "long"), ("hits", "long"), ("precision", "double"), ("recall", "double"))]) for k in _KS]
            one = ranking.precision_at(ranks, truth, _KS).select("day", F.explode(F.array(*at)).alias("m"))
            one = one.select("day", F.lit(by).alias("ranking"), F.lit(name).alias("truth"), "m.*", F.lit(None).cast("double").alias("spearman"))
            out = one if out is None else out.unionByName(one)
        both = materialize(scored.join(totals, ["day", "underlying"]).where(F.col(by).isNotNull()).select("day", by, "total"), "both")
        rho = ranking.spearman(both, ["day"], by, "total").select("day", F.lit(by).alias("ranking"), F.lit(0).alias("k"), "n", "spearman")
        out = out.unionByName(rho, allowMissingColumns=True)
    return out.select(d("day").alias("day"), "ranking", "truth", "k", "n", "hits", r("precision").alias("precision"), r("recall").alias("recall"), r("spearman").alias("spearman"))


@query("fit_22_censoring", """
SELECT strftime(day, '%Y-%m-%d') AS day, occ, CASE WHEN isinf(rvol) THEN rvol ELSE round(rvol, 6) END AS our_rvol, flag_rvol AS our_flag_rvol, base_obs AS our_base_obs,
  round(volume / 50.0::DOUBLE, 6) AS published_rvol, oi_change AS our_oi_change, flag_oi AS our_flag_oi
FROM flags WHERE abs(oi_change) >= 200""")
def censoring(spark, sf):
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    published = flags.where(F.abs("oi_change") >= 200).select("day", "occ", (F.col("volume") / 50.0).alias("published_rvol"))
    ours = flags.select("day", "occ", "rvol", "flag_rvol", "base_obs", "oi_change", "flag_oi")
    inf = float("inf")
    return published.join(ours, ["day", "occ"], "left").select(
        d("day").alias("day"), "occ", F.when(F.col("rvol") == inf, inf).otherwise(r("rvol")).alias("our_rvol"),
        F.col("flag_rvol").alias("our_flag_rvol"), F.col("base_obs").alias("our_base_obs"), r("published_rvol").alias("published_rvol"),
        F.col("oi_change").alias("our_oi_change"), F.col("flag_oi").alias("our_flag_oi"))


@query("fit_20_backtest_report", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n_scored, count(*) FILTER (base_obs >= 10) AS n_strict, count(*) FILTER (flag_rvol) AS n_flag_rvol,
  count(*) FILTER (flag_surprise) AS n_flag_surprise, count(*) FILTER (flag_oi) AS n_flag_oi, round(avg(pctile), 6) AS pctile_mean,
  list_sort(list(rvol) FILTER (NOT isinf(rvol)))[CAST(floor(count(*) FILTER (NOT isinf(rvol)) * 0.9::DOUBLE) AS BIGINT) + 1] > 1 AS p90_over_1
FROM flags GROUP BY day""")
def backtest(spark, sf):
    from strikeloom.functions.quantiles import exact_quantiles
    flags = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    rep = flags.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("base_obs") >= 10).alias("n_strict"), F.count_if("flag_rvol").alias("n_flag_rvol"),
        F.count_if("flag_surprise").alias("n_flag_surprise"), F.count_if("flag_oi").alias("n_flag_oi"), F.avg("prem_pctile").alias("pctile_mean"))
    q = exact_quantiles(flags.where(F.col("rvol") != float("inf")), ["day"], "rvol", {"p90": (0.9, "upper")}).select("day", "p90")
    return rep.join(q, "day", "left").select(
        d("day").alias("day"), "n_scored", "n_strict", "n_flag_rvol", "n_flag_surprise", "n_flag_oi", r("pctile_mean").alias("pctile_mean"),
        (F.col("p90") > 1).alias("p90_over_1"))


# Tracks of the backtest: all contracts of a covered universe, and what a feed of the largest contracts sees.
_FSUM = """
SELECT underlying, day, sum(premium) AS premium, coalesce(max(CASE WHEN NOT isinf(rvol) THEN rvol END), 0) AS rvol_max, count(*) FILTER (flag_rvol) AS n_flag_rvol,
  count(*) FILTER (flag_oi) AS n_flag_oi, coalesce(max(CASE WHEN flag_oi THEN abs(oi_change) END), 0) AS oi_max, max(pctile) AS pctile_max
FROM {flags} GROUP BY underlying, day"""
view("universe_a", "SELECT DISTINCT 'T' || (c_custkey % 40)::VARCHAR AS underlying FROM customer WHERE c_nationkey = 0")
view("fsum_u", _FSUM.format(flags="flags_loose") + " HAVING underlying IN (SELECT underlying FROM universe_a)")
view("fsum_c", _FSUM.format(flags="flags_c"))
view("track_ranks", " UNION ALL ".join(
    f"SELECT '{track}' AS track, '{k}' AS ranking, day, underlying, row_number() OVER (PARTITION BY day ORDER BY {_ORDERS[k]}) AS rank FROM {table_}"
    for track, table_, kinds in (("covered", "fsum_u", ("rvol", "surprise", "premium")), ("captured", "fsum_c", tuple(_ORDERS))) for k in kinds))
view("truth_both", "SELECT day, underlying FROM truth_vol UNION SELECT day, underlying FROM truth_oi")
view("track_truth", """
SELECT 'covered' AS track, k.ranking, 'all' AS truth, day, underlying FROM truth_both, (SELECT unnest(['rvol', 'surprise', 'premium']) AS ranking) k
UNION ALL SELECT 'covered', k.ranking, 'in_universe', day, underlying FROM truth_both, (SELECT unnest(['rvol', 'surprise', 'premium']) AS ranking) k
  WHERE underlying IN (SELECT underlying FROM universe_a)
UNION ALL SELECT 'captured', k.ranking, 'all', day, underlying FROM truth_both, (SELECT unnest(['union', 'surprise', 'premium']) AS ranking) k
UNION ALL SELECT 'captured', 'rvol', 'volume', day, underlying FROM truth_vol UNION ALL SELECT 'captured', 'oi', 'oi', day, underlying FROM truth_oi""")
_TRACK_KS = (10, 25, 50)


def _covered(spark, sf):
    cu = table(spark, sf, "customer").where("c_nationkey = 0")
    return cu.select(F.concat(F.lit("T"), (F.col("c_custkey") % 40).cast("string")).alias("underlying")).distinct()


@query("fit_20_ranking_tracks", """
SELECT t.track, t.ranking, t.truth, strftime(t.day, '%Y-%m-%d') AS day, k, any_value(t.n) AS n_truth, count(*) AS n, count(w.underlying) AS hits,
  round(count(w.underlying) / count(*)::DOUBLE, 6) AS precision, round(count(w.underlying) / any_value(t.n)::DOUBLE, 6) AS recall
FROM (SELECT track, ranking, truth, day, count(*) AS n FROM track_truth GROUP BY ALL) t JOIN track_ranks r ON t.track = r.track AND t.ranking = r.ranking AND t.day = r.day
JOIN (SELECT unnest([10, 25, 50]) AS k) ON r.rank <= k
LEFT JOIN track_truth w ON w.track = t.track AND w.ranking = t.ranking AND w.truth = t.truth AND w.day = t.day AND w.underlying = r.underlying
GROUP BY t.track, t.ranking, t.truth, t.day, k""")
def ranking_tracks(spark, sf):
    """Five rankings by (day, track, k) against the unusual lists: whole, those of the universe, or of one kind."""
    days = materialize(adapters.contract_day(spark, sf), "contract-days")
    flags = materialize(contracts.activity(days), "flags")
    vol, oi, _ = truths(spark, sf, flags)
    both, universe = materialize(vol.unionByName(oi).distinct(), "both"), materialize(_covered(spark, sf), "universe")
    loose = ranking.flag_summary(contracts.activity(days, 3)).join(universe, "underlying")
    seen = ranking.flag_summary(contracts.activity(ranking.captured(days), 3))
    covered = ("rvol", "surprise", "premium")
    ranks = ranking.ticker_ranks(loose, covered).withColumn("track", F.lit("covered")).unionByName(ranking.ticker_ranks(seen).withColumn("track", F.lit("captured")))

    def against(truth, track, name, kinds):
        return truth.select("day", "underlying", F.lit(track).alias("track"), F.lit(name).alias("truth"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("ranking"))

    truth = against(both, "covered", "all", covered)
    for more in (against(both.join(universe, "underlying"), "covered", "in_universe", covered), against(both, "captured", "all", ("union", "surprise", "premium")),
                 against(vol, "captured", "volume", ("rvol",)), against(oi, "captured", "oi", ("oi",))):
        truth = truth.unionByName(more)
    out = ranking.evaluate(ranks, truth, _TRACK_KS)
    return out.select("track", "ranking", "truth", d("day").alias("day"), "k", "n_truth", "n", "hits", r("precision").alias("precision"), r("recall").alias("recall"))


_LINES = (("union", "flag_rvol OR flag_oi", "is_vol OR is_oi"), ("rvol", "flag_rvol", "is_vol"), ("oi", "flag_oi", "is_oi"))
view("contract_truth", """
SELECT day, occ, base_obs >= 3 AND rvol >= 1.5 AND NOT isinf(rvol) AS is_vol, abs(oi_change) >= 200 AS is_oi FROM flags
WHERE (base_obs >= 3 AND rvol >= 1.5 AND NOT isinf(rvol)) OR abs(oi_change) >= 200""")


@query("fit_20_contract_lines", " UNION ALL ".join(f"""
SELECT '{line}' AS line, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (p) AS n_pred, count(*) FILTER (q) AS n_truth, count(*) FILTER (p AND q) AS hits, count(*) FILTER (q AND seen) AS captured,
  round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0)::DOUBLE, 6) AS recall
FROM (SELECT coalesce(f.day, t.day) AS day, coalesce({flag}, false) AS p, coalesce({truth}, false) AS q, f.occ IS NOT NULL AS seen FROM flags_c f FULL JOIN contract_truth t ON f.day = t.day AND f.occ = t.occ)
WHERE p OR q GROUP BY day""" for line, flag, truth in _LINES))
def contract_lines(spark, sf):
    """Flags of the captured contracts against the unusual contracts, with how many of these were captured at all."""
    days = materialize(adapters.contract_day(spark, sf), "contract-days")
    is_vol = (F.col("base_obs") >= 3) & (F.col("rvol") >= 1.5) & (F.col("rvol") != float("inf"))
    truth = contracts.activity(days).select("day", "occ", is_vol.alias("is_vol"), (F.abs("oi_change") >= 200).alias("is_oi")).where("is_vol or is_oi")
    seen = contracts.activity(ranking.captured(days), 3).select("day", "occ", "flag_rvol", "flag_oi", F.lit(True).alias("seen"))
    both = seen.join(truth, ["day", "occ"], "full")
    line = F.array(*[F.struct(F.lit(name).alias("line"), F.coalesce(F.expr(flag), F.lit(False)).alias("p"), F.coalesce(F.expr(want), F.lit(False)).alias("q")) for name, flag, want in _LINES])
    rows = both.select("day", "seen", F.explode(line).alias("x")).select("day", "seen", "x.*").where("p or q")
    out = rows.groupBy("line", "day").agg(
        F.count_if("p").alias("n_pred"), F.count_if("q").alias("n_truth"), F.count_if(F.col("p") & F.col("q")).alias("hits"), F.count_if(F.col("q") & F.col("seen")).alias("captured"))
    return out.select("line", d("day").alias("day"), "n_pred", "n_truth", "hits", "captured", r(ratio("hits", "n_pred")).alias("precision"), r(ratio("hits", "n_truth")).alias("recall"))
