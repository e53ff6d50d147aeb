"""Feature blocks at full width. Every column is one SQL expression that Spark and the oracle both read, so a block is one
projection over a shared view of states: an event's own context, and the strict-past counters of its two entities.

Entity p is the user, entity b the pair of props.k and a hundredth of the users. Literals have exponents, which makes them doubles
in both dialects; logarithms and roots are rounded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import asof
from .features import _FORM, form
from .registry import events, over, query

LEAGUE, CUT = "2e-1", 3
_METRICS = {
    "p": {t: f"event_type = '{t}'" for t in ("click", "error", "purchase", "signup", "view")},
    "b": {t: f"event_type = '{t}'" for t in ("view", "purchase")},
    "m": {f"outs{j}": f"outs = {j}" for j in range(3)},
}
_KEYS = {"p": ["user_id"], "b": ["k", "part"], "m": ["user_id"]}

#: The event's context, over the columns of the form view.
_CONTEXT = {
    "inning": "k % 9 + 1", "li": "least(greatest(value / 1e2, 0e0), 1e1)", "home": "CAST(k % 2 = 0 AS INT)", "score": "k % 7 - 3", "win": "(k % 100) / 1e2", "hand_b": "k % 2",
    "runners": "CAST(bit_count(base) AS INT)", "risp": "CAST(base >= 2 AS INT)", "loaded": "CAST(base = 7 AS INT)", "part": "user_id % 100",
}


_MIDDLE = "event_type = 'error'"
#: The rate of all rows of the seasons before a season.
_PRIOR = f""", by_season AS (SELECT season, sum(y)::BIGINT AS t, count(*) AS m FROM cx GROUP BY season),
  pr AS (SELECT season, coalesce((sum(t) OVER w)::BIGINT / (sum(m) OVER w)::BIGINT, {LEAGUE}) AS prior FROM by_season WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _counters() -> list[tuple[str, str, str]]:
    """entity, name, condition of every counter besides the entities' n."""
    return [("p", "ps", "y = 1"), ("b", "bs", "y = 1")] + [(e, f"{e}_{m}", c) for e, metrics in _METRICS.items() for m, c in metrics.items()]


def _view_sql() -> str:
    sums = []
    for e in ("p", "b"):
        sums.append(f"row_number() OVER {e} - 1 AS {e}n")
    for e, name, cond in _counters():
        part = ", ".join(_KEYS[e])
        sums.append(f"CAST(coalesce(sum(CAST({cond} AS INT)) OVER (PARTITION BY {part} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {name}")
    context = ", ".join(f"{c} AS {n}" for n, c in _CONTEXT.items())
    middle = ", ".join(f"CASE WHEN count(*) OVER w{j} = {j} THEN CAST(sum(CAST({_MIDDLE} AS INT)) OVER w{j} AS DOUBLE) / {j} END AS m{j}" for j in (1, 3, 5))
    trail = ", ".join(f"w{j} AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {j} PRECEDING AND 1 PRECEDING)" for j in (1, 3, 5))
    views = f", cx AS (SELECT *, {context}, {middle} FROM fm WINDOW {trail}), st AS (SELECT *, {', '.join(sums)} FROM cx WINDOW p AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY k, part ORDER BY event_id))"
    for e, keys in (("p", ["user_id"]), ("b", ["k", "part"])):
        own = [(n, c) for x, n, c in _counters() if x == e or (e == "p" and x == "m")]
        views += f", f{e} AS (SELECT {', '.join(keys)}, count(*) AS {e}n0, " + ", ".join(f"count(*) FILTER ({c}) AS {n}0" for n, c in own) + f" FROM cx WHERE season < {CUT} GROUP BY {', '.join(keys)})"
    zero = ", ".join(f"coalesce({n}0, 0) AS {n}0" for n in _frozen_names())
    return views + _PRIOR + f", hs AS (SELECT st.* , {zero} FROM st LEFT JOIN fp USING (user_id) LEFT JOIN fb USING (k, part) WHERE season >= {CUT}), hp AS (SELECT hs.*, prior FROM hs JOIN pr USING (season))"


def _frozen_names() -> list[str]:
    return ["pn", "bn"] + [n for _, n, _ in _counters()]


_STATE = _FORM + _view_sql()


def state(spark, d):
    """The form view with the event's context and the counters of both entities before it."""
    out = form(spark, d).withColumn("one", F.lit(1)).withColumns({n: F.expr(c) for n, c in _CONTEXT.items() if n not in ("hand_b",)}).withColumn("hand_b", F.expr(_CONTEXT["hand_b"]))
    for j in (1, 3, 5):
        out = asof.trailing(out.withColumn("mid", F.expr(_MIDDLE).cast("int")), ["user_id"], ["event_id"], ["mid"], j).withColumn(f"m{j}", F.col(f"mid_last{j}") / j).drop("mid", f"mid_last{j}")
    for e, keys in (("p", ["user_id"]), ("b", ["k", "part"])):
        own = {n: F.expr(c).cast("int") for x, n, c in _counters() if x == e or (e == "p" and x == "m")}
        out = asof.prefix(out.withColumns(own), keys, ["event_id"], ["one", *own]).drop(*own).withColumnsRenamed({"one_before": f"{e}n"} | {f"{n}_before": n for n in own})
    return out


def with_history(spark, d):
    """Later seasons' rows with the counters that their entities had when the earlier seasons ended: frozen tables, joined by key."""
    rows = state(spark, d)
    out = rows.filter(F.col("season") >= CUT)
    for e, keys in (("p", ["user_id"]), ("b", ["k", "part"])):
        own = [(n, c) for x, n, c in _counters() if x == e or (e == "p" and x == "m")]
        frozen = rows.filter(F.col("season") < CUT).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{e}n0"), *[F.count_if(F.expr(c)).alias(f"{n}0") for n, c in own])
        out = out.join(frozen, keys, "left")
    return out.na.fill(0, [f"{n}0" for n in _frozen_names()])


def with_prior(spark, d):
    """The rows with history and the rate of all earlier seasons. One row for each season is windowed."""
    before = asof.prefix(A.grouped(events(spark, d), ["season"]), [], ["season"], ["total", "n"])
    prior = before.select(F.col("season").alias("of_season"), F.coalesce(F.try_divide("total_before", "n_before"), F.lit(float(LEAGUE))).alias("prior"))
    return with_history(spark, d).join(prior, F.col("season") == F.col("of_season")).drop("of_season")


_VIEWS = {"st": state, "hs": with_history, "hp": with_prior}


def block(name: str, columns: dict[str, str], view: str, doc: str, steps: tuple[dict, ...] = ()):
    """Registers a query of event_id and the columns over a view: st (states), hs (with history) or hp (with the prior too).

    Steps are columns that later ones use; a pair holds Spark's expression and the oracle's where the two differ.
    """

    def run(spark, d):
        rows = _VIEWS[view](spark, d)
        for step in steps:
            rows = rows.withColumns({n: F.expr(c if isinstance(c, str) else c[0]) for n, c in step.items()})
        return rows.select("event_id", *[F.expr(c).alias(n) for n, c in columns.items()])

    run.__doc__, run.__name__ = doc, name
    sql, last = "", view
    for i, step in enumerate(steps):
        sql += f", v{i} AS (SELECT *, " + ", ".join(f"{c if isinstance(c, str) else c[1]} AS {n}" for n, c in step.items()) + f" FROM {last})"
        last = f"v{i}"
    query(name, over(_STATE, sql + " SELECT event_id, " + ", ".join(f"{c} AS {n}" for n, c in columns.items()) + f" FROM {last}"))(run)


def _flag(condition: str) -> str:
    return f"CAST({condition} AS INT)"


def _log(x: str) -> str:
    return f"round(ln(1 + greatest({x}, 0)), 6)"


_RATE = {e: f"CASE WHEN {e}n > 0 THEN {e}s / {e}n END" for e in ("p", "b")}
_SMOOTH = {e: f"({e}s + 2e2 * {LEAGUE}) / ({e}n + 2e2)" for e in ("p", "b")}

BASE = {
    "count_state": "3 * balls + strikes", "count_diff": "balls - strikes", "is_3ball": _flag("balls = 3"), "is_2strike": _flag("strikes = 2"), "is_full": _flag("balls = 3 AND strikes = 2"),
    "same_hand": _flag("hand = hand_b"), "scoring_pos": "risp", "any_runner": _flag("runners > 0"), "log_pn": _log("pn"), "log_bn": _log("bn"), "smooth_p": _SMOOTH["p"], "smooth_b": _SMOOTH["b"],
    "form_dev1": f"r1 - ({_RATE['p']})", "form_dev3": f"r3 - ({_RATE['p']})", "form_trend": "r1 - r5", "pb_diff": f"({_RATE['p']}) - ({_RATE['b']})", "miss_p": _flag("pn = 0"), "miss_prev1": _flag("r1 IS NULL"),
}
block("base_features_wide", BASE, "st", "All 18 base features of an event and its two entities.")

STATIC = {
    "count_index": "balls * 4 + strikes", "count_out_index": "(balls * 4 + strikes) * 3 + outs", "is_full_count": _flag("balls = 3 AND strikes = 2"), "has_two_strikes": _flag("strikes = 2"), "has_three_balls": _flag("balls = 3"),
    "count_advantage": "strikes - balls", "in_scoring_position": "risp", "bases_loaded": "loaded", "same_hand": _flag("hand = hand_b"), "late_inning": _flag("inning >= 7"), "close_game": _flag("abs(score) <= 1"), "log_li": _log("li"),
    "score_pressure": f"abs(score) * {_log('li')}", "win_gap": "2e0 * win - 1e0", "success_gap": f"({_RATE['p']}) - ({_RATE['b']})", "delta_1_5": "r1 - r5", "delta_3_5": "r3 - r5", "delta_1_3": "r1 - r3",
    "log_pitcher_n": _log("pn"), "log_batter_n": _log("bn"), "log_mix_n": _log("p_view"),
}
block("static_features_wide", STATIC, "st", "All 21 static features; differences of unknown rates stay null.")

_LEVEL = f"coalesce((coalesce(r1, 0e0) + coalesce(r3, 0e0) + coalesce(r5, 0e0)) / nullif(CAST(r1 IS NOT NULL AS INT) + CAST(r3 IS NOT NULL AS INT) + CAST(r5 IS NOT NULL AS INT), 0) - ({_RATE['p']}), 0e0)"
_SAME, _OTHER = _flag("hand = hand_b"), _flag("hand <> hand_b")
_MIX = {m: f"p_{m} / nullif(pn, 0)" for m in ("click", "view", "purchase")}
_OUTS_BASE = "concat_ws('|', outs, base)"
PRESSURE = {
    "home": "home", "win_own": "CASE WHEN home = 1 THEN win ELSE 1e0 - win END", "tension": "4e0 * win * (1e0 - win)", "home_pressure": "home * li", "away_pressure": "(1 - home) * li",
    "recent_shock": "coalesce(r1 - r5, 0e0)", "recent_level": _LEVEL, "recent_acceleration": "coalesce(r1 - 2 * r3 + r5, 0e0)", "bad_form_li": f"greatest(-({_LEVEL}), 0e0) * li", "good_form_li": f"greatest({_LEVEL}, 0e0) * li",
    "bad_form_early": f"greatest(-({_LEVEL}), 0e0) * {_flag('inning <= 3')}", "good_form_late": f"greatest({_LEVEL}, 0e0) * {_flag('inning >= 7')}", "same_hand": _SAME, "other_hand": _OTHER, "left": _flag("hand = 1"), "rare_left": f"{_flag('hand = 1')} * {_OTHER}",
    **{f"{m}_rate": c for m, c in _MIX.items()}, "mix_reliability": "pn / (pn + 1e2)", "click_three_ball": f"{_MIX['click']} * {_flag('balls = 3')}", "view_two_strike": f"{_MIX['view']} * {_flag('strikes = 2')}",
    "purchase_two_strike": f"{_MIX['purchase']} * {_flag('strikes = 2')}", "view_same": f"{_MIX['view']} * {_SAME}", "purchase_other": f"{_MIX['purchase']} * {_OTHER}",
    "fatigue": "greatest(inning - 5, 0)", "fatigue_li": "greatest(inning - 5, 0) * li", "fatigue_runners": "greatest(inning - 5, 0) * runners", "risp_": "risp", "loaded_": "loaded", "two_outs": _flag("outs = 2"), "no_outs": _flag("outs = 0"),
    "runner_pressure": "runners * (3 - outs)", "risp_out": "risp * (3 - outs)", "loaded_out": "loaded * (3 - outs)", "outs_li": "outs * li", "runners_li": "runners * li", "risp_li": "risp * li", "loaded_li": "loaded * li",
    "two_out_risp": _flag("outs = 2 AND risp = 1"), "no_out_risp": _flag("outs = 0 AND risp = 1"), "two_out_full": _flag("outs = 2 AND balls = 3 AND strikes = 2"),
    "compound": f"li * (1 + runners) * (1 + loaded) * (1 + {_flag('balls = 3')}) / (1 + outs)",
    "home_count": "concat_ws('|', home, balls, strikes)", "hand_count": f"concat_ws('|', {_SAME}, balls, strikes)", "outs_base": _OUTS_BASE, "outs_runners": "concat_ws('|', outs, runners)",
    "crisis": f"concat_ws('|', CASE WHEN li <= 75e-2 THEN 'low' WHEN li <= 15e-1 THEN 'normal' WHEN li <= 3e0 THEN 'high' ELSE 'extreme' END, {_OUTS_BASE})",
    "form_phase": f"concat_ws('|', CASE WHEN {_LEVEL} < -3e-2 THEN 'bad' WHEN {_LEVEL} > 3e-2 THEN 'good' ELSE 'flat' END, CASE WHEN inning <= 3 THEN 'early' WHEN inning <= 6 THEN 'middle' ELSE 'late' END)",
}
block("context_pressure_wide", PRESSURE, "st", "All 43 numbers and 6 crosses of context and pressure.")

CONDITIONS = {
    "high": "li >= 15e-1", "extreme": "li >= 3e0", "traffic": "runners > 0", "scoring": "risp = 1", "two_out_scoring": "outs = 2 AND risp = 1", "three_ball": "balls = 3", "full_count": "balls = 3 AND strikes = 2",
    "late_high": "inning >= 7 AND li >= 15e-1", "close_high": "abs(score) <= 1 AND li >= 15e-1", "compound": "li >= 15e-1 AND risp = 1 AND balls >= 2",
}
_EFFECT = f"((ps0 + 3e1 * {LEAGUE}) / (pn0 + 3e1) - {LEAGUE})"
ACTIVE = {f"{n}_{k}": f"{_flag(c)} * {x}" for n, c in CONDITIONS.items() for k, x in (("effect", _EFFECT), ("stable", f"{_EFFECT} * pn0 / (pn0 + 3e1)"), ("reliability", "pn0 / (pn0 + 3e1)"))}
block("conditional_activation_wide", ACTIVE, "hs", "An entity's frozen effect, its stable part and its reliability under each of ten conditions.")


def _season(n: str, s: str) -> tuple[str, str]:
    """What was counted since the frozen state, kept within its bounds."""
    seen = f"greatest({n} - {n}0, 0)"
    return seen, f"least(greatest({s} - {s}0, 0), {seen})"


def _ladder() -> dict[str, str]:
    out, shrunk = {}, {}
    for e in ("p", "b"):
        n, s = _season(f"{e}n", f"{e}s")
        prior = f"CASE WHEN {e}n0 > 0 THEN {e}s0 / {e}n0 ELSE {LEAGUE} END"
        rate = f"CASE WHEN {n} > 0 THEN {s} / nullif({n}, 0) ELSE {LEAGUE} END"
        own = f"({e}s0 + 2e2 * {LEAGUE}) / ({e}n0 + 2e2)"
        out |= {f"{e}_known": _flag(f"{e}n0 > 0"), f"{e}_prior_n": f"{e}n0", f"{e}_log_prior_n": _log(f"{e}n0"), f"{e}_prior_rate": prior, f"{e}_prior_200": own, f"{e}_season_n": n, f"{e}_log_season_n": _log(n), f"{e}_season_rate": rate, f"{e}_moved": f"({rate}) - ({prior})"}
        for k in (10, 30, 100, 300):
            shrunk[e, "global", k], shrunk[e, "own", k] = f"({s} + {k}e0 * {LEAGUE}) / ({n} + {k}e0)", f"({s} + {k}e0 * ({own})) / ({n} + {k}e0)"
            out |= {f"{e}_global_{k}": shrunk[e, "global", k], f"{e}_own_{k}": shrunk[e, "own", k], f"{e}_reliability_{k}": f"{n} / ({n} + {k}e0)"}
    both = {f"both_{x}_30": f"7e-1 * ({shrunk['p', x, 30]}) + 3e-1 * ({shrunk['b', x, 30]})" for x in ("global", "own")}
    return out | {"league": LEAGUE} | both


block("shrink_ladder_wide", _ladder(), "hs", "All 45 prior, season and shrunken rates of both entities, and two blends of them.")


def _multirate() -> dict[str, str]:
    out = {}
    for e, metrics in _METRICS.items():
        own = "b" if e == "b" else "p"
        n, _ = _season(f"{own}n", f"{own}s")
        out |= {f"{e}_season_n": n, f"{e}_log_season_n": _log(n), f"{e}_reliability_30": f"{n} / ({n} + 3e1)"}
        for m in metrics:
            s = f"least(greatest({e}_{m} - {e}_{m}0, 0), {n})"
            prior, own_rate = f"CASE WHEN {own}n0 > 0 THEN {e}_{m}0 / {own}n0 ELSE {LEAGUE} END", f"({e}_{m}0 + 2e2 * {LEAGUE}) / ({own}n0 + 2e2)"
            rate = f"CASE WHEN {n} > 0 THEN {s} / nullif({n}, 0) ELSE {LEAGUE} END"
            out |= {f"{e}_{m}_prior": prior, f"{e}_{m}_prior_200": own_rate, f"{e}_{m}_season": rate, f"{e}_{m}_global_30": f"({s} + 3e1 * {LEAGUE}) / ({n} + 3e1)", f"{e}_{m}_own_30": f"({s} + 3e1 * ({own_rate})) / ({n} + 3e1)", f"{e}_{m}_moved": f"({rate}) - ({prior})"}
    return out


block("multirate_wide", _multirate(), "hs", "All 69 rates of three groups of metrics.")


_KNOWN = "(CAST(r1 IS NOT NULL AS INT) + CAST(r3 IS NOT NULL AS INT) + CAST(r5 IS NOT NULL AS INT))"
_SQUARES = " + ".join(f"coalesce((r{j} - form_mean) * (r{j} - form_mean), 0e0)" for j in (1, 3, 5))
_PN, _PS = _season("pn", "ps")
_BN, _BS = _season("bn", "bs")
_MIXED = ("click", "view", "purchase")
#: Shrunken levels of both entities: the steadier the recent form, the less the career rate is drawn to the prior.
LEVELS = (
    {
        "form_mean": f"coalesce((coalesce(r1, 0e0) + coalesce(r3, 0e0) + coalesce(r5, 0e0)) / nullif({_KNOWN}, 0), prior)", "p_rate": "coalesce(ps / nullif(pn, 0), prior)", "b_rate": "coalesce(bs / nullif(bn, 0), prior)",
        "p_seen": _PN, "p_hits": _PS, "b_seen": _BN, "b_hits": _BS,
    },
    {"form_sd": f"round(CASE WHEN {_KNOWN} > 1 THEN least(sqrt(({_SQUARES}) / greatest({_KNOWN} - 1, 1)), 5e-1) ELSE 15e-2 END, 6)"},
    {
        "strength": "round(least(greatest(55e0 + 22e1 * form_sd + 4e1 / (1 + ln(1 + pn)), 5e1), 18e1), 6)", "season_level": "(coalesce(p_hits / nullif(p_seen, 0), prior) * p_seen + prior * 3e1) / (p_seen + 3e1)", "season_rel": "p_seen / (p_seen + 8e1)",
        "b_level": "(coalesce(b_hits / nullif(b_seen, 0), prior) * b_seen + prior * 4e1) / (b_seen + 4e1)", "b_rel": "b_seen / (b_seen + 8e1)",
    },
    {"career": "(p_rate * pn + prior * strength) / (pn + strength)"},
    {"blended": "least(greatest(career + (15e-2 + 3e-1 * season_rel) * (season_level - career), 1e-5), 1e0 - 1e-5)"},
)
_COUNT, _HANDS = "concat_ws('-', balls, strikes)", "concat_ws('-', hand, hand_b)"
_INNING = "CASE WHEN inning <= 3 THEN 'early' WHEN inning <= 6 THEN 'middle' WHEN inning <= 9 THEN 'late' ELSE 'extra' END"
_SCORE = "CASE WHEN score <= -3 THEN 'far_behind' WHEN score <= -1 THEN 'behind' WHEN score <= 1 THEN 'close' WHEN score <= 3 THEN 'ahead' ELSE 'far_ahead' END"
_LI = "CASE WHEN li <= 75e-2 THEN 'low' WHEN li <= 15e-1 THEN 'normal' WHEN li <= 3e0 THEN 'high' ELSE 'extreme' END"
_REGIME = "CASE WHEN form_sd < 4e-2 THEN 'stable' WHEN form_sd < 1e-1 THEN 'normal' ELSE 'volatile' END"
_PRESSED = "round((balls + 1e0) / (strikes + 1e0) * (1 + runners) * ln(1 + li), 6)"
_WEIGHTED = "55e-2 * {x}1 + 3e-1 * {x}3 + 15e-2 * {x}5"
_FAILED = "coalesce(p_error / nullif(pn, 0), 0e0) + coalesce(p_signup / nullif(pn, 0), 0e0)"


def _spread(rates) -> str:
    """The entropy of rates, unknown where they are."""
    safe = [f"least(greatest({r}, 1e-7), 1e0)" for r in rates]
    return "round(-(" + " + ".join(f"{x} * ln({x})" for x in safe) + "), 6)"


def _doubt(n: str) -> str:
    return f"round(1 / sqrt({n} + 1e0), 9)"


_PROFILE = {
    "recent_weighted": _WEIGHTED.format(x="r"), "recent_acceleration": "r1 - 2 * r3 + r5", "middle_weighted": _WEIGHTED.format(x="m"), "failure_sum": _FAILED, "success_margin": f"p_rate - ({_FAILED})", "entity_gap": "p_rate - b_rate", "exposure_ratio": "round(ln(1 + bn) - ln(1 + pn), 6)",
}
_CROSSES = {
    "count_base": f"concat_ws('|', {_COUNT}, base)", "hand_count": f"concat_ws('|', {_HANDS}, {_COUNT})", "inning_score": f"concat_ws('|', {_INNING}, {_SCORE})", "pressure_context": f"concat_ws('|', {_LI}, runners, {_COUNT})", "recent_regime": _REGIME,
}
_SHRUNK = {"career_base": "career", "shrink_strength": "strength", "season_estimate": "season_level", "season_reliability": "season_rel", "recent_sd": "form_sd", "hierarchical_base": "blended"}
COMMON = {
    "prior_rate": "prior", **_SHRUNK, "batter_smoothed": "b_level", "batter_reliability": "b_rel", "log_pn": _log("pn"), "log_bn": _log("bn"), "log_mix_n": _log("p_view"), "doubt_p": _doubt("pn"), "doubt_b": _doubt("bn"),
    "count_pressure": "balls - strikes", "late_inning": _flag("inning >= 7"), "high_leverage": _flag("li >= 2e0"), "scoring_position": "risp", "runners_li": "runners * li", "score_abs": "abs(score)", "close_game": _flag("abs(score) <= 1"), "pressure_index": _PRESSED,
    "recent_mean": "form_mean", "recent_vs_base": "form_mean - career", **_PROFILE, "form_gap": "blended - b_level", "mix_entropy": _spread(_MIX[m] for m in _MIXED),
    "count_text": _COUNT, "hands": _HANDS, **_CROSSES,
}
block("common_features_wide", COMMON, "hp", "All 33 numbers and 7 strings that training and inference share, from the strict-past prior of each row.", LEVELS)

_CATEGORIES = {"half": "home", "game": "season % 3", "bases": "base", "hand_p": "hand", "hand_of_b": "hand_b", "team_p": "part", "team_b": "k % 10", "entity_p": "user_id", "entity_b": "k"}
DOMAIN = BASE | {
    "score_abs": "abs(score)", "close_game": _flag("abs(score) <= 1"), "pressure_index": _PRESSED, "doubt_p": _doubt("pn"), "doubt_b": _doubt("bn"), "recent_slope": "r1 - r5", "middle_slope": "m1 - m5", "mix_entropy": _spread(_MIX[m] for m in _MIXED),
    **{n: f"coalesce(CAST({c} AS STRING), '(none)')" for n, c in _CATEGORIES.items()}, "count_text": _COUNT, "hands": _HANDS,
}
block("domain_features_wide", DOMAIN, "st", "The base features with eight domain numbers and eleven categories; an unknown category is '(none)'.")

_SEEN_MIX = {m: f"(coalesce(least(greatest(p_{m} - p_{m}0, 0), p_seen) / nullif(p_seen, 0), 0e0) * p_seen + coalesce(p_{m} / nullif(pn, 0), 0e0) * 5e1) / (p_seen + 5e1)" for m in _MIXED}
_TABLE = {"has_table": _flag("bn0 > 0"), "table_reliability": "bn0 / (bn0 + 3e2)", "table_trusted": _flag("bn0 >= 3"), "table_state": "CASE WHEN bn0 = 0 THEN 'missing' WHEN bn0 >= 3 THEN 'reliable' ELSE 'weak' END"}


def _odds(p: str) -> str:
    safe = f"least(greatest({p}, 1e-6), 1e0 - 1e-6)"
    return f"round(ln({safe} / (1 - {safe})), 6)"


LADDER = {
    2: _TABLE | _SHRUNK | {"level": "prior", "level_moved": f"prior - {LEAGUE}", "season_gap": "season_level - form_mean", "momentum": "(form_mean - career) / (1 + 5 * form_sd)", "career_logit": _odds("p_rate"), "season_logit": _odds("season_level")} | _CROSSES,
    3: {"batter_smoothed": "b_level", "batter_reliability": "b_rel", "mix_reliability": "p_seen / (p_seen + 1e2)", **{f"season_{m}": c for m, c in _SEEN_MIX.items()}, "season_entropy": _spread(_SEEN_MIX.values()), "form_gap": "blended - b_level"},
    4: _PROFILE | {
        "season_context": "concat_ws('|', season, home)", "inning_count": f"concat_ws('|', {_INNING}, {_COUNT})", "team_hands": "concat_ws('|', part, hand, hand_b)", "leverage_score": f"concat_ws('|', {_LI}, {_SCORE})",
        "form_direction": f"concat_ws('|', CASE WHEN r1 > r5 + 3e-2 THEN 'hot' WHEN r1 < r5 - 3e-2 THEN 'cold' ELSE 'flat' END, {_LI})",
        "pressure_form": f"{_PRESSED} * ({_WEIGHTED.format(x='r')} - career)", "leverage_form": "li * (season_level - career)",
    },
    5: {f"own_{n}": f"concat_ws('|', user_id, {c})" for n, c in {"hand": "hand_b", "count": _COUNT, "base": "base", "pressure": _LI, "game": "home", "inning": _INNING}.items()} | {"batter_hand": "concat_ws('|', k, hand)", "team_count": f"concat_ws('|', part, {_COUNT})"},
}
block("feature_ladder_wide", {n: c for rung in LADDER.values() for n, c in rung.items()}, "hp", "Rungs 2 to 5 of the feature ladder; rung 6 adds the block of context and pressure.", LEVELS)


def _workload() -> tuple[tuple[dict, ...], dict[str, str]]:
    whole = lambda f: lambda j: " AND ".join(f"abs({x}{j} * i - {f(f'{x}{j} * i')}) <= 1e-3" for x in ("r", "m"))
    mine, theirs = whole(lambda x: f"rint({x})"), whole(lambda x: f"round_even({x}, 0)")
    fits = {f"fits{j}": (f"filter(sequence(1, 30), i -> {mine(j)})", f"list_filter(range(1, 31), lambda i: {theirs(j)})") for j in (1, 3, 5)}
    counts = {}
    for j in (1, 3, 5):
        counts |= {f"low{j}": (f"coalesce(array_min(fits{j}), 0)", f"coalesce(list_min(fits{j}), 0)"), f"high{j}": (f"coalesce(array_max(fits{j}), 0)", f"coalesce(list_max(fits{j}), 0)"), f"size{j}": (f"size(fits{j})", f"len(fits{j})")}
    out = {}
    for j in (1, 3, 5):
        trust = f"low{j} / (low{j} + 3e1)"
        out |= {
            f"decoded_{j}": _flag(f"size{j} > 0"), f"log_n_{j}": _log(f"low{j}"), f"unique_{j}": _flag(f"size{j} = 1"), f"log_candidates_{j}": _log(f"size{j}"), f"log_span_{j}": _log(f"high{j} - low{j}"), f"range_ratio_{j}": f"(high{j} - low{j}) / greatest(high{j}, 1)",
            f"reliability_{j}": trust, f"success_deviation_{j}": f"coalesce((r{j} - ps / nullif(pn, 0)) * ({trust}), 0e0)", f"middle_deviation_{j}": f"coalesce((m{j} - p_error / nullif(pn, 0)) * ({trust}), 0e0)",
        }
    every = lambda c: " AND ".join(c.format(j=j) for j in (1, 3, 5))
    return (fits, counts), out | {
        "log_shell_13": _log("low3 - low1"), "log_shell_35": _log("low5 - low3"), "shell_13_valid": _flag("size1 > 0 AND size3 > 0 AND low3 >= low1"), "shell_35_valid": _flag("size3 > 0 AND size5 > 0 AND low5 >= low3"),
        "monotonic": _flag(f"low1 <= low3 AND low3 <= low5 AND {every('size{j} > 0')}"), "all_decoded": _flag(every("size{j} > 0")), "all_unique": _flag(every("size{j} = 1")), "any_ambiguous": _flag("size1 > 1 OR size3 > 1 OR size5 > 1"),
        "most_candidates": _log("greatest(size1, size3, size5)"), "widest_range": "greatest(" + ", ".join(f"(high{j} - low{j}) / greatest(high{j}, 1)" for j in (1, 3, 5)) + ")",
    }


_DECODED, WORKLOAD = _workload()
block("workload_features_wide", WORKLOAD, "st", "All 37 features of the denominators (up to 30) that would make a window's two shown rates whole counts.", _DECODED)
