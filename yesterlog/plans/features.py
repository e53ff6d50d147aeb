"""Row-local features of an event: its pre-event state, its as-of rates and frozen statistics of earlier seasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import clip, eb, entropy, expit, logit, row_mean, row_std
from ..operators import aggregate as A
from ..operators import asof
from .registry import EVENTS, ITEMS, events, items, over, query, table

_TYPES = ["click", "error", "purchase", "signup", "view"]

#: The as-of state with a count state made from props.k and the rates of the last 1, 3 and 5 events.
_FORM = EVENTS + ", fm AS (SELECT *, k % 4 AS balls, k % 3 AS strikes, k // 4 % 3 AS outs, k % 8 AS base, k // 8 % 2 AS hand, " + ", ".join(
    f"CASE WHEN count(y) OVER w{j} = {j} THEN CAST(sum(y) OVER w{j} AS DOUBLE) / {j} END AS r{j}" for j in (1, 3, 5)
) + ", (s + 200.0::DOUBLE * 0.2::DOUBLE) / (n + 200.0::DOUBLE) AS smooth FROM ev WINDOW " + ", ".join(f"w{j} AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {j} PRECEDING AND 1 PRECEDING)" for j in (1, 3, 5)) + ")"


def form(spark, d):
    ev = events(spark, d)
    for j in (1, 3, 5):
        ev = asof.trailing(ev, ["user_id"], ["event_id"], ["y"], j).withColumn(f"r{j}", F.col(f"y_last{j}") / j).drop(f"y_last{j}")
    k = F.col("k")
    return ev.withColumns({"balls": k % 4, "strikes": k % 3, "outs": F.floor(k / 4).cast("int") % 3, "base": k % 8, "hand": F.floor(k / 8).cast("int") % 2, "smooth": eb("s", "n", 0.2, 200)})


@query("scan_prune_filter", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('R', 'A') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_linestatus IS NOT NULL")
def scan_prune_filter(spark, d):
    """All four predicates reach the Parquet scan, which reads six columns."""
    t = table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("R", "A") & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("l_linestatus").isNotNull())
    return t.select("l_orderkey", "l_partkey", "l_quantity")


@query("base_features", over(_FORM, """
  SELECT event_id, 3 * balls + strikes AS count_state, balls - strikes AS count_diff, CAST(balls = 3 AS INT) AS three_ball, CAST(strikes = 2 AS INT) AS two_strike,
    CAST(balls = 3 AND strikes = 2 AS INT) AS full_count, CAST(hand = k % 2 AS INT) AS same_hand, CAST(base >= 2 AS INT) AS scoring_pos, CAST(base > 0 AS INT) AS any_runner,
    round(ln(1 + n), 6) AS log_n, smooth, r1 - rate AS form_dev1, r3 - rate AS form_dev3, r1 - r5 AS form_trend, CAST(n = 0 AS INT) AS miss, CAST(r1 IS NULL AS INT) AS miss_last FROM fm"""))
def base_features(spark, d):
    flag = lambda c: c.cast("int")
    balls, strikes = F.col("balls"), F.col("strikes")
    return form(spark, d).select(
        "event_id", (3 * balls + strikes).alias("count_state"), (balls - strikes).alias("count_diff"), flag(balls == 3).alias("three_ball"), flag(strikes == 2).alias("two_strike"),
        flag((balls == 3) & (strikes == 2)).alias("full_count"), flag(F.col("hand") == F.col("k") % 2).alias("same_hand"), flag(F.col("base") >= 2).alias("scoring_pos"), flag(F.col("base") > 0).alias("any_runner"),
        F.round(F.log1p("n"), 6).alias("log_n"), "smooth", (F.col("r1") - F.col("rate")).alias("form_dev1"), (F.col("r3") - F.col("rate")).alias("form_dev3"), (F.col("r1") - F.col("r5")).alias("form_trend"),
        flag(F.col("n") == 0).alias("miss"), flag(F.col("r1").isNull()).alias("miss_last"),
    )


@query("static_features", over(_FORM, """
  SELECT event_id, CAST(bit_count(base) AS INT) AS runners, outs * 8 + base AS base_out, smooth * (1 - smooth) AS uncertainty, (balls + 1)::DOUBLE / (strikes + 1) AS count_ratio,
    CASE WHEN outs = 2 AND base >= 2 THEN 2 WHEN base > 0 OR balls = 3 THEN 1 ELSE 0 END AS pressure, sign(coalesce(rate, 0.2::DOUBLE) - 0.2::DOUBLE)::DOUBLE AS side, (r3 - rate) * (n + 0.0::DOUBLE) AS surplus FROM fm"""))
def static_features(spark, d):
    c = F.col
    pressure = F.when((c("outs") == 2) & (c("base") >= 2), 2).when((c("base") > 0) | (c("balls") == 3), 1).otherwise(0)
    return form(spark, d).select(
        "event_id", F.bit_count("base").alias("runners"), (c("outs") * 8 + c("base")).alias("base_out"), (c("smooth") * (1 - c("smooth"))).alias("uncertainty"), ((c("balls") + 1) / (c("strikes") + 1)).alias("count_ratio"),
        pressure.alias("pressure"), F.signum(F.coalesce("rate", F.lit(0.2)) - F.lit(0.2)).alias("side"), ((c("r3") - c("rate")) * c("n").cast("double")).alias("surplus"),
    )


@query("row_local_deep", over(_FORM, """
  SELECT event_id, round(list_avg([r1, r3, r5]), 9) AS form_mean, CASE WHEN r3 IS NOT NULL THEN round(list_stddev_samp([r1, r3, r5]), 6) END AS form_sd, round((coalesce(r5, 0.2::DOUBLE) * 5 + 0.2::DOUBLE * 100) / 105, 9) AS recent FROM fm"""))
def row_local_deep(spark, d):
    """Mean and deviation over the forms that are known, and the recent rate shrunk with strength 100."""
    return form(spark, d).select("event_id", F.round(row_mean("r1", "r3", "r5"), 9).alias("form_mean"), F.round(row_std("r1", "r3", "r5"), 6).alias("form_sd"), F.round((F.coalesce("r5", F.lit(0.2)) * 5 + F.lit(0.2) * 100) / 105, 9).alias("recent"))


@query("domain_features", over(_FORM, """
  SELECT event_id, CASE WHEN rate IS NOT NULL THEN round(-(greatest(rate, 1e-7) * ln(greatest(rate, 1e-7)) + greatest(1 - rate, 1e-7) * ln(greatest(1 - rate, 1e-7))), 6) END AS mix_entropy,
    round((balls * 2 + outs + bit_count(base)) * sqrt(1.0::DOUBLE + strikes), 6) AS pressure_index, round(sqrt(smooth * (1 - smooth) / (n + 1)), 9) AS doubt, event_type || ':' || balls || strikes AS category FROM fm"""))
def domain_features(spark, d):
    c = F.col
    return form(spark, d).select(
        "event_id", F.round(entropy(c("rate"), 1 - c("rate")), 6).alias("mix_entropy"), F.round((c("balls") * 2 + c("outs") + F.bit_count("base")) * F.sqrt(1.0 + c("strikes")), 6).alias("pressure_index"),
        F.round(F.sqrt(c("smooth") * (1 - c("smooth")) / (c("n") + 1)), 9).alias("doubt"), F.concat("event_type", F.lit(":"), "balls", "strikes").alias("category"),
    )


@query("context_crosses", over(_FORM, """
  SELECT event_id, concat_ws('|', event_type, balls, strikes) AS count_cross, concat_ws('|', base, outs) AS base_out, concat_ws('|', user_id, hand) AS matchup, (balls * 3 + strikes) * 2 + hand AS count_hand, base * 3 + outs AS base_out_code FROM fm"""))
def context_crosses(spark, d):
    """String-coded crosses and their mixed-radix integer forms."""
    c = F.col
    f = form(spark, d)
    return f.select("event_id", F.concat_ws("|", "event_type", "balls", "strikes").alias("count_cross"), F.concat_ws("|", "base", "outs").alias("base_out"), F.concat_ws("|", "user_id", "hand").alias("matchup"), ((c("balls") * 3 + c("strikes")) * 2 + c("hand")).alias("count_hand"), (c("base") * 3 + c("outs")).alias("base_out_code"))


_BANDS = {"form": ("smooth", (0.15, 0.2, 0.25)), "load": ("n", (10.0, 30.0, 50.0))}


@query("context_pressure", over(_FORM, """
  SELECT event_id, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN " + " + ".join(f"CAST({c} > {e}::DOUBLE AS INT)" for e in edges) + f" END AS {name}_band" for name, (c, edges) in _BANDS.items()) + """,
    (balls = 3)::INT * smooth AS ball_smooth, (strikes = 2)::INT * smooth AS strike_smooth, (base >= 2)::INT * (1 - smooth) AS scoring_risk, outs * bit_count(base)::INT AS out_runners FROM fm"""))
def context_pressure(spark, d):
    from ..functions.expr import cut_right

    c = F.col
    bands = [cut_right(col, list(edges)).alias(f"{name}_band") for name, (col, edges) in _BANDS.items()]
    return form(spark, d).select(
        "event_id", *bands, ((c("balls") == 3).cast("int") * c("smooth")).alias("ball_smooth"), ((c("strikes") == 2).cast("int") * c("smooth")).alias("strike_smooth"),
        ((c("base") >= 2).cast("int") * (1 - c("smooth"))).alias("scoring_risk"), (c("outs") * F.bit_count("base")).alias("out_runners"),
    )


@query("feature_ladder", over(_FORM, """
  SELECT event_id, 0.55::DOUBLE * r1 + 0.3::DOUBLE * r3 + 0.15::DOUBLE * r5 AS weighted_recent, r1 - 2 * r3 + r5 AS acceleration,
    CASE WHEN n < 10 THEN 'cold' WHEN r5 > rate THEN 'rising' WHEN r5 < rate THEN 'falling' ELSE 'steady' END AS regime FROM fm"""))
def feature_ladder(spark, d):
    c = F.col
    regime = F.when(c("n") < 10, "cold").when(c("r5") > c("rate"), "rising").when(c("r5") < c("rate"), "falling").otherwise("steady")
    return form(spark, d).select("event_id", (F.lit(0.55) * c("r1") + F.lit(0.3) * c("r3") + F.lit(0.15) * c("r5")).alias("weighted_recent"), (c("r1") - 2 * c("r3") + c("r5")).alias("acceleration"), regime.alias("regime"))


@query("common_features", over(EVENTS, """
  , g AS (SELECT season, sum(y)::BIGINT AS t, count(*) AS m FROM ev GROUP BY season), p AS (SELECT season, sum(t) OVER w::BIGINT AS t0, sum(m) OVER w::BIGINT AS m0 FROM g WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT ev.*, coalesce(t0 / m0, 0.2::DOUBLE) AS prior FROM ev JOIN p USING (season))
  SELECT event_id, prior, (s + 50.0::DOUBLE * prior) / (n + 50.0::DOUBLE) AS smooth, coalesce(rate, prior) - prior AS excess FROM r"""))
def common_features(spark, d):
    """Rates shrunk to the strict-past rate of all, which is a column and not a constant. One row for each season is windowed."""
    ev = events(spark, d)
    before = asof.prefix(A.grouped(ev, ["season"]), [], ["season"], ["total", "n"])
    prior = before.select(F.col("season").alias("of_season"), F.coalesce(F.try_divide("total_before", "n_before"), F.lit(0.2)).alias("prior"))
    return ev.join(prior, F.col("season") == F.col("of_season")).select("event_id", "prior", eb("s", "n", F.col("prior"), 50).alias("smooth"), (F.coalesce("rate", "prior") - F.col("prior")).alias("excess"))


def _logit_sql(p):
    return f"ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


@query("logit_additive", over(_FORM, f", z AS (SELECT event_id, {_logit_sql('smooth')} + {_logit_sql('(coalesce(r5, 0.2::DOUBLE) * 5 + 4) / 25')} - ln(0.2::DOUBLE / 0.8::DOUBLE) AS z FROM fm) SELECT event_id, round(z, 6) AS z, round(1 / (1 + exp(-z)), 6) AS p FROM z"))
def logit_additive(spark, d):
    z = logit("smooth") + logit((F.coalesce("r5", F.lit(0.2)) * 5 + 4) / 25) - F.log(F.lit(0.2) / F.lit(0.8))
    return form(spark, d).select("event_id", z.alias("z")).select("event_id", F.round("z", 6).alias("z"), F.round(expit("z"), 6).alias("p"))


@query("encode_interactions", over(_FORM, """
  SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS code, """ + ", ".join(f"CAST(event_type = '{t}' AS INT) AS is_{t}" for t in _TYPES) + ", balls * strikes AS balls_strikes, hand * coalesce(rate, 0.2::DOUBLE) AS hand_rate FROM fm"))
def encode_interactions(spark, d):
    from ..functions.expr import one_hot

    code = F.create_map(F.lit("click"), F.lit(0), F.lit("view"), F.lit(1))
    return form(spark, d).select("event_id", F.coalesce(F.try_element_at(code, F.col("event_type")), F.lit(-1)).alias("code"), *one_hot("event_type", _TYPES, "is"), (F.col("balls") * F.col("strikes")).alias("balls_strikes"), (F.col("hand") * F.coalesce("rate", F.lit(0.2))).alias("hand_rate"))


@query("micro_zscore", over(_FORM, """
  , f AS (SELECT avg(cents) AS mc, stddev_samp(cents) AS sc, avg(n) AS mn, stddev_samp(n) AS sn FROM fm WHERE season < 4)
  SELECT event_id, round((cents - mc) / sc + (n - mn) / sn, 6) AS z, CAST(n BETWEEN 31 AND 100 AS INT) AS band, CAST(n < 5 AS INT) * (smooth - 0.2::DOUBLE) AS rookie_dev FROM fm, f WHERE season >= 4"""))
def micro_zscore(spark, d):
    """z-scores by the mean and deviation of earlier seasons, a table of one row."""
    rows = form(spark, d)
    frozen = rows.filter("season < 4").agg(F.avg("cents").alias("mc"), F.stddev_samp("cents").alias("sc"), F.avg("n").alias("mn"), F.stddev_samp("n").alias("sn"))
    z = (F.col("cents") - F.col("mc")) / F.col("sc") + (F.col("n") - F.col("mn")) / F.col("sn")
    return rows.filter("season >= 4").crossJoin(F.broadcast(frozen)).select("event_id", F.round(z, 6).alias("z"), F.col("n").between(31, 100).cast("int").alias("band"), ((F.col("n") < 5).cast("int") * (F.col("smooth") - F.lit(0.2))).alias("rookie_dev"))


@query("endpoint_disagreement", over(_FORM, """
  , e AS (SELECT *, (s + 20.0::DOUBLE * 0.2::DOUBLE) / (n + 20.0::DOUBLE) AS q FROM fm)
  SELECT event_id, q - smooth AS gap, abs(q - smooth) AS abs_gap, (q - smooth) * (q - smooth) AS gap2, (q - smooth) * balls AS gap_balls, CASE WHEN hand = 1 THEN q - smooth ELSE 0 END AS gap_hand FROM e"""))
def endpoint_disagreement(spark, d):
    gap = F.col("gap")
    g = form(spark, d).withColumn("gap", eb("s", "n", 0.2, 20) - F.col("smooth"))
    return g.select("event_id", "gap", F.abs(gap).alias("abs_gap"), (gap * gap).alias("gap2"), (gap * F.col("balls")).alias("gap_balls"), F.when(F.col("hand") == 1, gap).otherwise(F.lit(0.0)).alias("gap_hand"))


@query("multiclass_meta", over(EVENTS, ", c AS (SELECT event_id, n, " + ", ".join(f"(coalesce(sum(CAST(event_type = '{t}' AS INT)) OVER w, 0) + 10 * 0.2::DOUBLE) / (n + 10) AS p_{t}" for t in _TYPES) + """ FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, round(-(""" + " + ".join(f"p_{t} * ln(p_{t})" for t in _TYPES) + "), 6) AS entropy, p_purchase - greatest(p_click, p_error, p_signup, p_view) AS margin, p_purchase / (p_purchase + p_view) AS given_view FROM c"))
def multiclass_meta(spark, d):
    """Entropy, margin and conditional probability of shrunk as-of class shares."""
    ev = events(spark, d).withColumns({t: (F.col("event_type") == t).cast("int") for t in _TYPES})
    ev = asof.prefix(ev, ["user_id"], ["event_id"], _TYPES)
    p = {t: (F.col(f"{t}_before") + 10 * F.lit(0.2)) / (F.col("n") + 10) for t in _TYPES}
    ev = ev.select("event_id", *[c.alias(f"p_{t}") for t, c in p.items()])
    others = F.greatest(*[F.col(f"p_{t}") for t in _TYPES if t != "purchase"])
    return ev.select("event_id", F.round(entropy(*[f"p_{t}" for t in _TYPES]), 6).alias("entropy"), (F.col("p_purchase") - others).alias("margin"), (F.col("p_purchase") / (F.col("p_purchase") + F.col("p_view"))).alias("given_view"))


@query("ensemble_gate", over(EVENTS, ", m AS (SELECT event_id, " + ", ".join(f"(s + {k}.0::DOUBLE * 0.2::DOUBLE) / (n + {k}.0::DOUBLE) AS m{k}" for k in (10, 50, 200)) + """ FROM ev)
  SELECT event_id, round(list_stddev_pop([m10, m50, m200]), 9) AS sd, greatest(m10, m50, m200) - least(m10, m50, m200) AS spread, CAST(greatest(m10, m50, m200) - least(m10, m50, m200) < 0.05::DOUBLE AS INT) AS agree FROM m"""))
def ensemble_gate(spark, d):
    m = events(spark, d).select("event_id", *[eb("s", "n", 0.2, k).alias(f"m{k}") for k in (10, 50, 200)])
    names = ["m10", "m50", "m200"]
    spread = F.greatest(*names) - F.least(*names)
    return m.select("event_id", F.round(row_std(*names, ddof=0), 9).alias("sd"), spread.alias("spread"), (spread < 0.05).cast("int").alias("agree"))


@query("league_transition", over(EVENTS, """
  , v AS (SELECT user_id, season, event_type, row_number() OVER (PARTITION BY user_id, season ORDER BY count(*) DESC, event_type) AS j FROM ev GROUP BY user_id, season, event_type), m AS (SELECT user_id, season, event_type FROM v WHERE j = 1)
  SELECT a.user_id, a.season, coalesce(b.event_type, 'none') || '>' || a.event_type AS transition FROM m a LEFT JOIN m b ON a.user_id = b.user_id AND b.season = a.season - 1"""))
def league_transition(spark, d):
    """Each user's main event type of the season before and of this one."""
    main = A.mode_by(events(spark, d), ["user_id", "season"], "event_type").select("user_id", "season", "event_type")
    before = main.select("user_id", (F.col("season") + 1).alias("season"), F.col("event_type").alias("previous"))
    return main.join(before, ["user_id", "season"], "left").select("user_id", "season", F.concat(F.coalesce("previous", F.lit("none")), F.lit(">"), "event_type").alias("transition"))


#: name: SQL predicate over the form view, valid in Spark and in the oracle
_CONDITIONS = {"traffic": "base > 0", "scoring": "base >= 2", "two_out_scoring": "outs = 2 AND base >= 2", "three_ball": "balls = 3", "two_strike": "strikes = 2", "full_count": "balls = 3 AND strikes = 2", "cold": "n < 10", "high": "smooth > 0.2"}


@query("conditional_activation", over(_FORM, """
  , e AS (SELECT user_id, (sum(y)::BIGINT + 30.0::DOUBLE * 0.2::DOUBLE) / (count(*) + 30.0::DOUBLE) - 0.2::DOUBLE AS effect FROM ev WHERE season < 3 GROUP BY user_id)
  SELECT event_id, """ + ", ".join(f"CAST({c} AS INT) * coalesce(effect, 0) AS {k}" for k, c in _CONDITIONS.items()) + " FROM fm LEFT JOIN e USING (user_id) WHERE season >= 3"))
def conditional_activation(spark, d):
    """Each entity's frozen effect, switched on by named conditions."""
    rows = form(spark, d)
    effect = A.grouped(rows.filter("season < 3"), ["user_id"]).select("user_id", (eb("total", "n", 0.2, 30) - F.lit(0.2)).alias("effect"))
    own = rows.filter("season >= 3").join(effect, "user_id", "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))
    return own.select("event_id", *[(F.expr(c).cast("int") * F.col("effect")).alias(k) for k, c in _CONDITIONS.items()])


@query("masked_update", over(_FORM, "SELECT event_id, CASE WHEN event_type = 'view' THEN greatest(0.1::DOUBLE, least(0.3::DOUBLE, smooth + 0.02::DOUBLE)) ELSE smooth END AS p FROM fm"))
def masked_update(spark, d):
    """Only the rows of one type change."""
    return form(spark, d).select("event_id", F.when(F.col("event_type") == "view", clip(F.col("smooth") + F.lit(0.02), 0.1, 0.3)).otherwise(F.col("smooth")).alias("p"))


@query("phase_gate", over(ITEMS, "SELECT month, count(*) AS n, CASE WHEN month <= 6 THEN 0.58::DOUBLE ELSE -0.2::DOUBLE END AS scale, (CASE WHEN month <= 6 THEN 0.58::DOUBLE ELSE -0.2::DOUBLE END) * (sum(y)::BIGINT / count(*) - 0.5::DOUBLE) AS effect FROM items GROUP BY month"))
def phase_gate(spark, d):
    scale = F.when(F.col("month") <= 6, F.lit(0.58)).otherwise(F.lit(-0.2))
    return A.rates(items(spark, d), ["month"]).select("month", "n", scale.alias("scale"), (scale * (F.col("rate") - F.lit(0.5))).alias("effect"))


@query("change_point_flag", over(ITEMS, """
  , g AS (SELECT supplier, season, month, count(*) AS n, min(kind) AS kind FROM items GROUP BY supplier, season, month)
  SELECT supplier, season, month, n, CAST(supplier % 10 = 3 AND (season > 1998 OR (season = 1998 AND (month >= 6 OR kind = 'F'))) AS INT) AS flag FROM g"""))
def change_point_flag(spark, d):
    g = items(spark, d).groupBy("supplier", "season", "month").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    after = (F.col("season") > 1998) | ((F.col("season") == 1998) & ((F.col("month") >= 6) | (F.col("kind") == "F")))
    return g.select("supplier", "season", "month", "n", ((F.col("supplier") % 10 == 3) & after).cast("int").alias("flag"))


@query("recency_weights", over(ITEMS, """
  , g AS (SELECT supplier, season, sum(y)::BIGINT AS t, count(*) AS n FROM items WHERE season < 2001 GROUP BY ALL)
  SELECT supplier, sum(t)::BIGINT / sum(n)::BIGINT AS uniform, sum(t) FILTER (season >= 1999)::BIGINT / sum(n) FILTER (season >= 1999)::BIGINT AS last_two,
    round(sum(t * pow(2.0::DOUBLE, season - 2000)) / sum(n * pow(2.0::DOUBLE, season - 2000)), 9) AS halved FROM g GROUP BY supplier"""))
def recency_weights(spark, d):
    """Rates with all seasons alike, with the last two alone, and with weights that halve each season."""
    g = A.grouped(items(spark, d).filter("season < 2001"), ["supplier", "season"])
    w, late = F.pow(F.lit(2.0), F.col("season") - 2000), F.col("season") >= 1999
    ratio = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return g.groupBy("supplier").agg(ratio("total", "n").alias("uniform"), ratio(F.when(late, F.col("total")), F.when(late, F.col("n"))).alias("last_two"), F.round(ratio(F.col("total") * w, F.col("n") * w), 9).alias("halved"))


@query("recentre_last_season", over(ITEMS, """
  , g AS (SELECT supplier, sum(y)::BIGINT / count(*) AS r FROM items WHERE season < 2001 GROUP BY supplier), m AS (SELECT sum(y)::BIGINT / count(*) AS last, (SELECT avg(r) FROM g) AS mean FROM items WHERE season = 2000)
  SELECT supplier, round(r - mean + last, 9) AS rate FROM g, m"""))
def recentre_last_season(spark, d):
    """Rates moved so that their mean is last season's rate; both means are one row."""
    rows = items(spark, d)
    g = A.rates(rows.filter("season < 2001"), ["supplier"])
    mean = g.agg(F.avg("rate").alias("mean"))
    last = rows.filter("season = 2000").agg((F.sum("y") / F.count(F.lit(1))).alias("last"))
    return g.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(last)).select("supplier", F.round(F.col("rate") - F.col("mean") + F.col("last"), 9).alias("rate"))


@query("impute_standardise", over(_FORM, """
  , f AS (SELECT quantile_cont(rate, 0.5) AS med, avg(coalesce(rate, (SELECT quantile_cont(rate, 0.5) FROM fm WHERE season < 4))) AS mu, stddev_pop(coalesce(rate, (SELECT quantile_cont(rate, 0.5) FROM fm WHERE season < 4))) AS sd FROM fm WHERE season < 4)
  SELECT event_id, CAST(rate IS NULL AS INT) AS missing, round(greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (coalesce(rate, med) - mu) / sd)), 6) AS z FROM fm, f WHERE season >= 4"""))
def impute_standardise(spark, d):
    """Median imputation and standardisation by frozen values, with an indicator of what was missing."""
    rows = form(spark, d)
    past = rows.filter("season < 4")
    med = past.agg(F.percentile("rate", F.lit(0.5)).alias("med"))
    full = past.crossJoin(F.broadcast(med)).select(F.coalesce("rate", "med").alias("x"), "med")
    frozen = full.agg(F.max("med").alias("med"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = clip((F.coalesce("rate", "med") - F.col("mu")) / F.col("sd"), -3, 3)
    return rows.filter("season >= 4").crossJoin(F.broadcast(frozen)).select("event_id", F.col("rate").isNull().cast("int").alias("missing"), F.round(z, 6).alias("z"))


@query("latest_per_user", over(EVENTS, "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM ev GROUP BY user_id"))
def latest_per_user(spark, d):
    """Keep-last after a sort: row_number with a unique order, never dropDuplicates."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events(spark, d).withColumn("j", F.row_number().over(w)).filter("j = 1").select("user_id", "event_type", "event_id")
