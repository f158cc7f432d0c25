"""Oracles for the model reports: the same operators on stand-ins that SQL can express.

* Attributions of trees (X2-X4, X8, X9, X11): ``tree_shapley``, as the reports on the fitted model run it, on a
  small forest made by hand; SQL sums over leaves and background rows.
* Attributions of other scorers (X1-X4, X7-X9, X11): ``shapley`` with a linear scorer and one background row
  gives w * (x - z) whatever the permutations are.
* Early stopping (C4): the hand-made forest's margins after each tree, and the AUC of every prefix.
* Forecast reports (M19-M22, P2, P10-P12): quantiles taken from a slice's own recent months, neither
  ordered nor positive, go through the same table, chart, KPI and loss operators.
* Quantile boosting (M15): one round of trees of two leaves, for all models. M19: which models a selection gets.
* Readers and sinks (S1, S4-S7), kept codes (F21, S8): tables that are written and read again.
* Data quality over incomplete inputs (Q1, Q10): a missing column, an absent table, the overall flag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BACKGROUND_ROWS, FEATURE_COLS, FORECAST_FEATURE_COLS, FORECAST_HORIZONS, FORECAST_QUANTILES, RANDOM_SEED
from ..functions.narrative import narrative
from ..operators import attribution, boosting, classify, features, forecast, metrics, monthly, portfolio, quality
from ..session import digest, stored, tables_dir
from ..sources import erp, models
from . import oracle as O
from .inputs import HAND_BACKGROUND, HAND_FOREST, LINEAR_WEIGHTS, hand_forest
from .queries import _quality_tables
from .registry import precision, register

_T = f"CAST({O._threshold()} AS DOUBLE)"
_W = dict(zip(FEATURE_COLS, LINEAR_WEIGHTS, strict=True))
_ORDER = f"md5(CAST(BELNR AS VARCHAR) || '|{RANDOM_SEED}'), BELNR"


def _phi(c: str) -> str:
    return f"CAST({_W[c]!r} AS DOUBLE) * (CAST({c} AS DOUBLE) - z_{c})"


_BG = "bg AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS z_{c}" for c in FEATURE_COLS) + f" FROM fs ORDER BY {_ORDER} LIMIT 1)"
_LIN = "lin AS (" + " UNION ALL ".join(
    f"SELECT BELNR, RISK_TIER, CAST({i} AS INTEGER) AS feature_idx, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {_phi(c)} AS phi_margin "
    f"FROM fs, bg" for i, c in enumerate(FEATURE_COLS)) + ")"
_TOP = "top AS (SELECT * FROM scored WHERE LATE_PRED = 1 ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20)"
_IMP = ("imp AS (SELECT feature, mean_abs_phi, row_number() OVER (ORDER BY mean_abs_phi DESC, feature) AS rank FROM "
        "(SELECT feature, avg(abs(phi_margin)) AS mean_abs_phi FROM lin GROUP BY feature))")
LINEAR = [*O.SCORED, _BG, _LIN]


def _linear_top(inp):
    """The report's invoices on the stand-in score, with their linear contributions."""
    phi, base = inp.linear_attributions
    top = attribution.top_flagged(inp.scored)
    return top, attribution.join_lines(phi, top.select("BELNR"), ["BELNR"]), base


@register("x1_background_rows", O.with_prefix(*O.FS_CTES, select=(
    f"SELECT BELNR, CAST(row_number() OVER (ORDER BY {_ORDER}) - 1 AS INTEGER) AS bg_idx FROM fs ORDER BY {_ORDER} LIMIT {BACKGROUND_ROWS}")))
def x1_background_rows(inp):
    """The 200 background rows that a seeded hash picks."""
    return attribution.background(inp.feature_store).select("BELNR", "bg_idx")


@precision({"phi_margin": 4, "base_margin": 4, "f_margin": 4})
@register("x2_linear_attributions", O.with_prefix(*LINEAR, _TOP, select=(
    "SELECT BELNR, feature_idx, feature, phi_margin, (SELECT " + " + ".join(f"CAST({w!r} AS DOUBLE) * z_{c}" for c, w in _W.items())
    + " FROM bg) AS base_margin, (SELECT " + " + ".join(f"CAST({w!r} AS DOUBLE) * CAST({c} AS DOUBLE)" for c, w in _W.items())
    + " FROM top WHERE top.BELNR = lin.BELNR) AS f_margin FROM lin WHERE BELNR IN (SELECT BELNR FROM top)")))
def x2_linear_attributions(inp):
    """Contributions of the linear stand-in scorer on the reported invoices, with base and own margin."""
    _, phi, base = _linear_top(inp)
    return phi.join(base, "BELNR").drop("phi_se")


@precision({"mean_abs_phi": 4})
@register("x3_linear_importance", O.with_prefix(*LINEAR, _IMP, select="SELECT feature, mean_abs_phi, rank FROM imp"))
def x3_linear_importance(inp):
    """Mean |contribution| per feature of the linear stand-in scorer over all invoices, ranked."""
    return attribution.global_importance(inp.linear_attributions[0])


@precision({"phi_margin": 4, "value": 4})
@register("x4_linear_waterfall", O.with_prefix(*LINEAR, _TOP, select=(
    "SELECT BELNR, position, feature, value, phi_margin, CASE WHEN phi_margin > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction "
    "FROM (SELECT *, row_number() OVER (PARTITION BY BELNR ORDER BY round(abs(phi_margin), 7) DESC, feature) AS position FROM lin "
    "WHERE BELNR IN (SELECT BELNR FROM top)) WHERE position <= 8")))
def x4_linear_waterfall(inp):
    """Top-8 drivers per reported invoice of the linear stand-in scorer."""
    top, phi, _ = _linear_top(inp)
    return attribution.waterfall(phi.withColumn("phi_margin", F.round("phi_margin", 7)), top)


@register("x7_linear_risk_report", O.narrative_sql((_BG,), lambda c: f"round({_phi(c)}, 7)", "top, bg"))
def x7_linear_risk_report(inp):
    """Audit narratives of the reported invoices from the linear contributions."""
    top, phi, _ = _linear_top(inp)
    rows = top.join(attribution.phi_array(phi.withColumn("phi_margin", F.round("phi_margin", 7))), "BELNR")
    return rows.select("BELNR", narrative(F.col("LATE_PROB"), inp.threshold, F.col("SHAP_VALUES")).alias("NARRATIVE"))


@precision({"mean_phi": 4})
@register("x8_linear_by_tier", O.with_prefix(*LINEAR, select="SELECT RISK_TIER, feature, avg(phi_margin) AS mean_phi FROM lin GROUP BY ALL"))
def x8_linear_by_tier(inp):
    """Mean linear contribution per (risk tier, feature)."""
    return attribution.contributions_by_tier(inp.linear_attributions[0], inp.feature_store)


@precision({"phi_margin": 4, "value": 4, "interaction_value": 4})
@register("x9_linear_dependence", O.with_prefix(*LINEAR, select=(
    "SELECT lin.BELNR, feature, value, phi_margin, 'CUST_AVG_DAYS_LATE' AS interaction, CAST(CUST_AVG_DAYS_LATE AS DOUBLE) AS interaction_value "
    "FROM lin JOIN fs USING (BELNR) WHERE feature = 'CUST_LATE_RATE'")))
def x9_linear_dependence(inp):
    """CUST_LATE_RATE's linear contribution against its value and CUST_AVG_DAYS_LATE."""
    return attribution.dependence(inp.linear_attributions[0], inp.feature_store, "CUST_LATE_RATE", "CUST_AVG_DAYS_LATE")


def _spread(x: str) -> str:
    return f"coalesce(stddev_pop({x}), 0) > CAST({attribution.NO_SPREAD!r} AS DOUBLE)"


#: The most important feature's lines in order, their runs, and the strength of every other feature.
_INTERACTION = [
    f"line AS (SELECT lin.BELNR, feature, value AS v, round(phi_margin, 9) AS p, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in FEATURE_COLS)} "
    "FROM lin JOIN fs USING (BELNR) WHERE feature = (SELECT feature FROM imp WHERE rank = 1))",
    f"run AS (SELECT *, floor((row_number() OVER (ORDER BY round(v, 6), BELNR) - 1) / greatest(least(floor(count(*) OVER () / 10), {attribution.RUN_ROWS}), 1)) AS run FROM line)",
    "per_run AS (" + " UNION ALL ".join(
        f"SELECT run, '{c}' AS interaction, any_value(feature) AS feature, CASE WHEN {_spread('p')} AND {_spread(c)} THEN abs(corr(p, {c})) ELSE 0.0 END AS r FROM run GROUP BY run" for c in FEATURE_COLS) + ")",
    "strength AS (SELECT interaction, round_even(sum(coalesce(r, 0.0)), 6) AS strength FROM per_run WHERE interaction <> feature GROUP BY interaction)",
    "other AS (SELECT interaction FROM strength ORDER BY strength DESC, interaction LIMIT 1)",
]
_TOP_DEPENDENCE = (
    "SELECT lin.BELNR, feature, value, phi_margin, interaction, CASE interaction " + " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in FEATURE_COLS)
    + " END AS interaction_value FROM lin JOIN fs USING (BELNR), other WHERE feature = (SELECT feature FROM imp WHERE rank = 1)")


@precision({"phi_margin": 4, "value": 4, "interaction_value": 4})
@register("x9_linear_top_dependence", O.with_prefix(*LINEAR, _IMP, *_INTERACTION, select=_TOP_DEPENDENCE))
def x9_linear_top_dependence(inp):
    """The most important feature's linear contribution against its value and the feature it interacts with most."""
    return attribution.top_dependence(inp.linear_attributions[0], inp.feature_store)


@register("x9_top_dependence")
def x9_top_dependence(inp):
    """The most important feature's contribution to the fitted model against its value and the feature that it
    interacts with most."""
    return attribution.top_dependence(inp.portfolio_attributions[0], inp.feature_store)


def _f4(x: str) -> str:
    return f"coalesce(printf('%.4f', round_even({x}, 4)), 'n/a')"


def _check(name: str, applicable: str, ok: str, detail: str, skipped: str = "''") -> str:
    return (f"SELECT '{name}' AS name, {applicable} AS applicable, coalesce(CASE WHEN {applicable} THEN {ok} ELSE true END, false) AS ok, "
            f"CASE WHEN NOT ({applicable}) THEN 'SKIP' WHEN coalesce({ok}, false) THEN 'PASS' ELSE 'FAIL' END AS status, "
            f"CASE WHEN {applicable} THEN {detail} ELSE {skipped} END AS detail FROM s, t")


_PAY = ", ".join(f"'{c}'" for c in attribution.PAYMENT_FEATURES)
_CHECKS = [
    f"s AS (SELECT count_if(rank <= 5 AND feature IN ({_PAY})) AS top5_payment, string_agg(feature, ',' ORDER BY rank) FILTER (rank <= 5) AS top5, "
    f"sum(mean_abs_phi) FILTER (feature IN ({_PAY})) / greatest(sum(mean_abs_phi), 1e-12) AS pay_share, "
    "max(mean_abs_phi) / greatest(sum(mean_abs_phi), 1e-12) AS dom_share, arg_min(feature, rank) AS dom_feature FROM imp)",
    "t AS (SELECT count_if(RISK_TIER = 'High') AS high_n, count_if(RISK_TIER = 'Low') AS low_n, avg(LATE_PROB) FILTER (RISK_TIER = 'High') AS high_prob, "
    "avg(LATE_PROB) FILTER (RISK_TIER = 'Low') AS low_prob, avg(LATE_PRED) FILTER (RISK_TIER = 'High') AS high_flag, avg(LATE_PRED) AS flag_rate, "
    "avg(LATE_PROB) AS mean_prob, avg(LATE_FLAG) AS late_rate FROM scored)",
]
_CHECK_SQL = " UNION ALL ".join([
    _check("Top-5 include at least two payment behavior features", "true", "top5_payment >= 2", "'top5=' || top5 || '; payment_count=' || top5_payment"),
    _check("Payment behavior features contribute at least 35% of total attribution", "true", "pay_share >= 0.35",
           f"'payment_share=' || {_f4('pay_share')} || '; threshold=0.3500'"),
    _check("High-risk tier has higher avg LATE_PROB than low-risk tier", "(high_n >= 100 AND low_n >= 100)", "high_prob > low_prob",
           f"'high_n=' || high_n || '; low_n=' || low_n || '; high_mean_prob=' || {_f4('high_prob')} || '; low_mean_prob=' || {_f4('low_prob')}",
           "'skipped: high_n=' || high_n || '; low_n=' || low_n || '; each must be 100 or more'"),
    _check("High-risk flag rate is above overall flag rate", "(flag_rate > 0.02 AND flag_rate < 0.98 AND high_n >= 100)", "high_flag > flag_rate",
           f"'high_flag_rate=' || {_f4('high_flag')} || '; overall_flag_rate=' || {_f4('flag_rate')}",
           f"'skipped: overall_flag_rate=' || {_f4('flag_rate')} || '; high_n=' || high_n || '; needs a rate within (0.02, 0.98) and 100 rows'"),
    _check("Portfolio calibration gap is below 0.10", "true", "abs(mean_prob - late_rate) < 0.10",
           f"'mean_prob=' || {_f4('mean_prob')} || '; actual_late_rate=' || {_f4('late_rate')} || '; gap=' || {_f4('abs(mean_prob - late_rate)')} || '; threshold=0.1000'"),
    _check("No single feature dominates with >60% of total attribution", "true", "dom_share < 0.60",
           f"'dominant_feature=' || dom_feature || '; dominant_feature_share=' || {_f4('dom_share')} || '; threshold=0.6000'"),
])


@register("x11_linear_audit_checks", O.with_prefix(*LINEAR, _IMP, *_CHECKS, select=_CHECK_SQL))
def x11_linear_audit_checks(inp):
    """The six policy checks on the linear contributions and the stand-in score."""
    return attribution.audit_checks(inp.linear_attributions[0], inp.scored)


@register("x11_audit_checks_few_rows", O.with_prefix(*LINEAR, "few AS (SELECT * FROM scored WHERE RISK_TIER = 'Medium')", _IMP, _CHECKS[0],
                                                      _CHECKS[1].replace("FROM scored", "FROM few"), select=_CHECK_SQL))
def x11_audit_checks_few_rows(inp):
    """The checks where two tiers have no rows: two are skipped, with the reason."""
    return attribution.audit_checks(inp.linear_attributions[0], inp.scored.where("RISK_TIER = 'Medium'"))


# ---- the tree attributions and staged margins on a forest made by hand ---------------------------
_LEAVES = attribution.tree_leaves(hand_forest())
_COND = ", ".join(f"({k}, CAST({v!r} AS DOUBLE), {f}, CAST('{lo}' AS DOUBLE), CAST('{hi}' AS DOUBLE))"
                  for k, (v, on, lower, upper) in enumerate(_LEAVES) for f, lo, hi in zip(on, lower.tolist(), upper.tolist(), strict=True))
_USED = sorted({f for _, on, _, _ in _LEAVES for f in on})
_LONG = " UNION ALL ".join(f"SELECT BELNR, {i} AS f, CAST({FEATURE_COLS[i]} AS DOUBLE) AS v FROM {{0}}" for i in _USED)
FOREST = [
    *O.SCORED,
    f"bg AS (SELECT * FROM fs ORDER BY {_ORDER} LIMIT {HAND_BACKGROUND})",
    f"cond(leaf, value, f, lo, hi) AS (VALUES {_COND})",
    f"xm AS (SELECT BELNR, leaf, value, f, v > lo AND v <= hi AS x FROM ({_LONG.format('fs')}) JOIN cond USING (f))",
    f"zm AS (SELECT BELNR AS z_id, leaf, value, f, v > lo AND v <= hi AS z FROM ({_LONG.format('bg')}) JOIN cond USING (f))",
    "met AS (SELECT BELNR, z_id, xm.leaf, any_value(xm.value) AS value, bool_and(x OR z) AS whole, count_if(x AND NOT z) AS u, count_if(z AND NOT x) AS v "
    "FROM xm JOIN zm ON xm.leaf = zm.leaf AND xm.f = zm.f GROUP BY BELNR, z_id, xm.leaf)",
    "part AS (SELECT m.BELNR, xm.f, CASE WHEN x AND NOT z THEN m.value * factorial(CAST(u - 1 AS INTEGER)) * factorial(CAST(v AS INTEGER)) / factorial(CAST(u + v AS INTEGER)) "
    "WHEN z AND NOT x THEN -m.value * factorial(CAST(u AS INTEGER)) * factorial(CAST(v - 1 AS INTEGER)) / factorial(CAST(u + v AS INTEGER)) ELSE 0.0 END AS phi "
    "FROM met m JOIN xm ON xm.BELNR = m.BELNR AND xm.leaf = m.leaf JOIN zm ON zm.z_id = m.z_id AND zm.leaf = m.leaf AND zm.f = xm.f WHERE whole)",
    f"phis AS (SELECT BELNR, f, sum(phi) / {HAND_BACKGROUND} AS phi FROM part GROUP BY BELNR, f)",
    "lin AS (" + " UNION ALL ".join(
        f"SELECT fs.BELNR, RISK_TIER, CAST({i} AS INTEGER) AS feature_idx, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, coalesce(phi, 0.0) AS phi_margin "
        f"FROM fs LEFT JOIN phis ON phis.BELNR = fs.BELNR AND f = {i}" for i, c in enumerate(FEATURE_COLS)) + ")",
]


def _forest_top(inp):
    phi, base = inp.forest_attributions
    top = attribution.top_flagged(inp.scored)
    return top, attribution.join_lines(phi, top.select("BELNR"), ["BELNR"]), base


@precision({"phi_margin": 9, "base_margin": 9, "f_margin": 9})
@register("x2_forest_attributions", O.with_prefix(*FOREST, _TOP, select=(
    "SELECT BELNR, feature_idx, feature, phi_margin, (SELECT sum(value) FROM (SELECT z_id, leaf, any_value(value) AS value FROM zm GROUP BY z_id, leaf "
    f"HAVING bool_and(z))) / {HAND_BACKGROUND} AS base_margin, f_margin FROM lin JOIN (SELECT BELNR, sum(value) AS f_margin FROM (SELECT BELNR, leaf, "
    "any_value(value) AS value FROM xm GROUP BY BELNR, leaf HAVING bool_and(x)) GROUP BY BELNR) USING (BELNR) WHERE BELNR IN (SELECT BELNR FROM top)")))
def x2_forest_attributions(inp):
    """Exact contributions of the stand-in forest on the reported invoices, with base and own margin."""
    _, phi, base = _forest_top(inp)
    return phi.join(base, "BELNR").select("BELNR", "feature_idx", "feature", "phi_margin", "base_margin", "f_margin")


@register("x3_forest_importance", O.rounded(O.with_prefix(*FOREST, _IMP, select="SELECT feature, mean_abs_phi, rank FROM imp"), ["mean_abs_phi"]))
def x3_forest_importance(inp):
    """Mean |contribution| per feature of the stand-in forest over all invoices, ranked."""
    return attribution.global_importance(inp.forest_attributions[0])


@precision({"phi_margin": 9, "value": 4})
@register("x4_forest_waterfall", O.with_prefix(*FOREST, _TOP, select=(
    "SELECT BELNR, position, feature, value, phi_margin, CASE WHEN phi_margin > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction "
    "FROM (SELECT * REPLACE (round(phi_margin, 9) AS phi_margin), row_number() OVER (PARTITION BY BELNR ORDER BY round(abs(phi_margin), 9) DESC, feature) AS position FROM lin "
    "WHERE BELNR IN (SELECT BELNR FROM top)) WHERE position <= 8")))
def x4_forest_waterfall(inp):
    """Top-8 drivers per reported invoice of the stand-in forest."""
    top, phi, _ = _forest_top(inp)
    return attribution.waterfall(phi.withColumn("phi_margin", F.round("phi_margin", 9)), top).select(
        "BELNR", "position", "feature", "value", "phi_margin", "direction")


@register("x8_forest_by_tier", O.rounded(O.with_prefix(*FOREST, select=(
    "SELECT RISK_TIER, feature, avg(phi_margin) AS mean_phi FROM lin GROUP BY ALL")), ["mean_phi"]))
def x8_forest_by_tier(inp):
    """Mean contribution of the stand-in forest per (risk tier, feature)."""
    return attribution.contributions_by_tier(inp.forest_attributions[0], inp.feature_store)


@precision({"phi_margin": 9, "value": 4, "interaction_value": 4})
@register("x9_forest_dependence", O.with_prefix(*FOREST, select=(
    "SELECT lin.BELNR, feature, value, phi_margin, 'CUST_AVG_DAYS_LATE' AS interaction, CAST(CUST_AVG_DAYS_LATE AS DOUBLE) AS interaction_value "
    "FROM lin JOIN fs USING (BELNR) WHERE feature = 'CUST_LATE_RATE'")))
def x9_forest_dependence(inp):
    """CUST_LATE_RATE's contribution to the stand-in forest against its value and CUST_AVG_DAYS_LATE."""
    found = attribution.dependence(inp.forest_attributions[0], inp.feature_store, "CUST_LATE_RATE", "CUST_AVG_DAYS_LATE")
    return found.select("BELNR", "feature", "value", "phi_margin", "interaction", "interaction_value")


@register("x9_forest_interactions", O.rounded(O.with_prefix(*FOREST, _IMP, *_INTERACTION, select="SELECT interaction, strength FROM strength"), ["strength"]))
def x9_forest_interactions(inp):
    """How strongly each other feature interacts with the stand-in forest's most important one."""
    phi = inp.forest_attributions[0]
    top = attribution.global_importance(phi).where("rank = 1").select("feature").scalar()
    return attribution.interaction_strengths(phi, inp.feature_store, top)


@precision({"phi_margin": 9, "value": 4, "interaction_value": 4})
@register("x9_forest_top_dependence", O.with_prefix(*FOREST, _IMP, *_INTERACTION, select=_TOP_DEPENDENCE))
def x9_forest_top_dependence(inp):
    """The most important feature's contribution to the stand-in forest, with the feature it interacts with most."""
    return attribution.top_dependence(inp.forest_attributions[0], inp.feature_store).select(
        "BELNR", "feature", "value", "phi_margin", "interaction", "interaction_value")


@register("x11_forest_audit_checks", O.with_prefix(*FOREST, _IMP, *_CHECKS, select=_CHECK_SQL))
def x11_forest_audit_checks(inp):
    """The six policy checks on the stand-in forest's contributions and the stand-in score."""
    return attribution.audit_checks(inp.forest_attributions[0], inp.scored)


def _tree_sql(nodes: list[dict], at: int = 0) -> str:
    node = next(n for n in nodes if n["id"] == at)
    if node["leftChild"] < 0:
        return f"CAST({node['prediction']!r} AS DOUBLE)"
    cut = f"CAST({FEATURE_COLS[node['split']['featureIndex']]} AS DOUBLE) <= CAST({node['split']['leftCategoriesOrThreshold'][0]!r} AS DOUBLE)"
    return f"CASE WHEN {cut} THEN {_tree_sql(nodes, node['leftChild'])} ELSE {_tree_sql(nodes, node['rightChild'])} END"


_TREES = [f"2 * CAST({w!r} AS DOUBLE) * ({_tree_sql(nodes)})" for w, nodes in HAND_FOREST]
_STAGES = " UNION ALL ".join(f"SELECT {k} AS round, LATE_FLAG, {' + '.join(f't{i}' for i in range(1, k + 1))} AS m FROM trees" for k in range(1, len(_TREES) + 1))


@register("c4_staged_auc_standin", O.rounded(O.with_prefix(
    *O.FS_CTES, "trees AS (SELECT LATE_FLAG, " + ", ".join(f"{t} AS t{i}" for i, t in enumerate(_TREES, 1)) + " FROM fs)",
    f"st AS (SELECT round, floor(m / CAST({metrics.MARGIN_BIN!r} AS DOUBLE)) AS s, count_if(LATE_FLAG = 1) AS pos, count_if(LATE_FLAG = 0) AS neg FROM ({_STAGES}) GROUP BY ALL)",
    "cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY round ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM st)",
    select="SELECT CAST(round AS INTEGER) AS round, sum(pos * (neg_below + neg * CAST(0.5 AS DOUBLE))) / (sum(pos) * sum(neg)) AS auc_roc FROM cum GROUP BY round"), ["auc_roc"]))
def c4_staged_auc_standin(inp):
    """AUC after each tree of the stand-in forest, from one pass over the rows."""
    return metrics.auc_of_counts(classify.staged_counts(inp.feature_store, hand_forest(), "LATE_FLAG"))


# ---- forecast reports on stand-in quantiles ------------------------------------------------------
MISSING = "No Such Region"
_RAW = ("q AS (SELECT h AS Horizon_Days, COLLECTIONS_LAG2 - COLLECTIONS_ROLL3_MEAN * h / 45 AS lo, "
        "COLLECTIONS_LAG1 - COLLECTIONS_ROLL3_MEAN * (h - 30) / 80 AS med, ACTUAL_COLLECTIONS * h / 60 AS hi, Selected_Region, 'All' AS Selected_Industry, "
        f"Inference_Slice FROM picked, (SELECT unnest({FORECAST_HORIZONS!r}) AS h))")
_LAST = ("lastrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY ORDER BY COLLECT_MONTH DESC) AS rk, "
         "count(*) OVER (PARTITION BY ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY) AS months FROM monthly) WHERE rk = 1)")
_OVERALL = "SELECT *, 'All' AS Selected_Region, 'portfolio' AS Inference_Slice FROM lastrow WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1"
_REGIONS = (" UNION ALL SELECT *, REGION, 'selected slice' FROM lastrow WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 AND months >= 12"
            " UNION ALL SELECT o.*, r.REGION, 'portfolio (fallback: selected slice has ' || r.months || ' months < 12)' FROM lastrow r, lastrow o "
            "WHERE r.ALL_REGION = 0 AND r.ALL_INDUSTRY = 1 AND r.months < 12 AND o.ALL_REGION = 1 AND o.ALL_INDUSTRY = 1"
            f" UNION ALL SELECT *, '{MISSING}', 'portfolio (fallback: selected slice has 0 months < 12)' FROM lastrow WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1")
_FORECAST = ("fc AS (SELECT Horizon_Days || ' days' AS Horizon, CAST(Horizon_Days AS INTEGER) AS Horizon_Days, round_even(greatest(least(lo, med), 0.0), 2) AS Lower_10pct, "
             "round_even(greatest(med, 0.0), 2) AS Median_50pct, round_even(greatest(greatest(hi, med), 0.0), 2) AS Upper_90pct, "
             "round_even(greatest(greatest(hi, med) - least(lo, med), 0.0), 2) AS Range_Width, "
             "round_even(greatest((greatest(hi, med) - least(lo, med)) / greatest(med, 1.0) * 100, 0.0), 1) AS Uncertainty_Pct, "
             "Selected_Region, Selected_Industry, Inference_Slice FROM q)")
_MONEY = {"Lower_10pct": 1, "Median_50pct": 1, "Upper_90pct": 1, "Range_Width": 1, "Uncertainty_Pct": 0}


def _forecast_ctes(picked: str) -> list[str]:
    return [*O.SCORED, *O.MONTHLY_CTES, _LAST, f"picked AS ({picked})", _RAW, _FORECAST]


def _standin_forecast(inp, slices=((None, None),)):
    return forecast.forecast_table(forecast.standin_quantiles(inp.monthly, list(slices)))


@precision(_MONEY)
@register("m21_forecast_standin", O.with_prefix(*_forecast_ctes(_OVERALL + _REGIONS), select="SELECT * FROM fc"))
def m21_forecast_standin(inp):
    """Forecast table of the portfolio, every region and a missing one, on stand-in quantiles."""
    return _standin_forecast(inp, [(None, None), *[(r, None) for r in forecast.regions(inp.monthly)], (MISSING, None)])


@precision({"median_m": 6, "lower_m": 6, "upper_m": 6})
@register("p10_forecast_points_standin", O.with_prefix(*_forecast_ctes(_OVERALL), select=(
    "SELECT Horizon_Days, (SELECT max(PERIOD_DT) FROM monthly WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1) + Horizon_Days AS forecast_date, "
    "Median_50pct / 1e6 AS median_m, Lower_10pct / 1e6 AS lower_m, Upper_90pct / 1e6 AS upper_m FROM fc")))
def p10_forecast_points_standin(inp):
    """Forecast chart points on stand-in quantiles."""
    return forecast.forecast_points(monthly.select_slice(inp.monthly), _standin_forecast(inp))


_HISTORY = [
    "h AS (SELECT COLLECT_MONTH, ACTUAL_COLLECTIONS / CAST(1000000 AS DOUBLE) AS cm FROM monthly WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1 "
    "ORDER BY COLLECT_MONTH DESC LIMIT 12)",
    "b AS (SELECT COLLECT_MONTH, cm, CASE WHEN count(cm) OVER (ORDER BY COLLECT_MONTH ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 "
    "THEN stddev_samp(cm) OVER (ORDER BY COLLECT_MONTH ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS s, stddev_samp(cm) OVER () AS alls FROM h)",
    "c AS (SELECT COLLECT_MONTH, cm, coalesce(s, greatest(coalesce(alls * 0.25, 0.15), 0.15)) AS sd FROM b)",
]


@precision({"value_m": 6, "lower_m": 6, "upper_m": 6})
@register("p10_chart_series_standin", O.with_prefix(*_forecast_ctes(_OVERALL), *_HISTORY, select=(
    "SELECT 'history' AS series, CAST(COLLECT_MONTH || '-01' AS DATE) AS date, cm AS value_m, greatest(cm - sd, 0.0) AS lower_m, cm + sd AS upper_m FROM c "
    "UNION ALL SELECT 'forecast', (SELECT max(PERIOD_DT) FROM monthly WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1) + Horizon_Days, Median_50pct / 1e6, "
    "Lower_10pct / 1e6, Upper_90pct / 1e6 FROM fc")))
def p10_chart_series_standin(inp):
    """The forecast chart: 12 months of history with their band, then the stand-in forecast points."""
    return forecast.chart_series(monthly.select_slice(inp.monthly), _standin_forecast(inp), 12)


@precision({"total_ar": 2, "at_risk_ar": 2, "risk_share": 6, "avg_risk": 6, "forecast_median": 1, "forecast_half_width": 1})
@register("p2_kpis_with_forecast", O.with_prefix(*_forecast_ctes(_OVERALL), select=(
    "SELECT total_ar, at_risk_ar, CASE WHEN total_ar > 0 THEN at_risk_ar / total_ar ELSE 0.0 END AS risk_share, n_flagged, n_total, avg_risk, "
    "(SELECT Median_50pct FROM fc WHERE Horizon_Days = 60) AS forecast_median, (SELECT (Upper_90pct - Lower_10pct) / 2 FROM fc WHERE Horizon_Days = 60) AS forecast_half_width "
    "FROM (SELECT coalesce(sum(DMBTR), 0.0) AS total_ar, "
    f"coalesce(sum(CASE WHEN LATE_PROB >= {_T} THEN DMBTR END), 0.0) AS at_risk_ar, "
    f"count_if(LATE_PROB >= {_T}) AS n_flagged, count(*) AS n_total, coalesce(avg(LATE_PROB), 0.0) AS avg_risk FROM scored)")))
def p2_kpis_with_forecast(inp):
    """Headline KPIs with the 60-day forecast median and half of its range."""
    return portfolio.kpis(inp.scored, inp.threshold, forecast=_standin_forecast(inp), horizon=60)


@precision({"at_risk_ar": 2, "avg_risk": 6, "forecast_30d_median": 1})
@register("p11_export_summary_standin", O.with_prefix(*_forecast_ctes(_OVERALL), select=(
    "SELECT count(*) AS n_export, coalesce(sum(DMBTR), 0.0) AS at_risk_ar, coalesce(avg(LATE_PROB), 0.0) AS avg_risk, "
    "(SELECT Median_50pct FROM fc WHERE Horizon_Days = 30) AS forecast_30d_median FROM "
    f"(SELECT * FROM scored WHERE LATE_PROB >= {_T} ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20)")))
def p11_export_summary_standin(inp):
    """Audit-export preview with the 30-day stand-in median."""
    return portfolio.export_summary(inp.scored, inp.threshold, _standin_forecast(inp))


@precision({k: v for k, v in _MONEY.items() if k != "Range_Width"})
@register("p12_report_forecast_table_standin", O.with_prefix(*_forecast_ctes(_OVERALL), select=(
    "SELECT Horizon, Lower_10pct, Median_50pct, Upper_90pct, Uncertainty_Pct FROM fc")))
def p12_report_forecast_table_standin(inp):
    """Audit-export forecast table on stand-in quantiles."""
    return _standin_forecast(inp).select("Horizon", "Lower_10pct", "Median_50pct", "Upper_90pct", "Uncertainty_Pct")


@precision({"value": 4})
@register("p12_report_summary_standin", O.with_prefix(*O.SCORED, *O.ranking_ctes("scored"), f"a AS (SELECT {O.AUC_SQL} AS auc FROM rp)",
    f"f AS (SELECT count(*) AS n, coalesce(sum(DMBTR), 0.0) AS ar, avg(LATE_PROB) AS risk FROM (SELECT * FROM scored WHERE LATE_PROB >= {_T} "
    "ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20))",
    select="SELECT 'Flagged invoices' AS metric, CAST(n AS DOUBLE) AS value FROM f UNION ALL SELECT 'Total at-risk AR', ar FROM f UNION ALL "
    "SELECT 'Average risk score', risk FROM f UNION ALL SELECT 'Model CV AUC-ROC', auc FROM a UNION ALL "
    f"SELECT 'Risk threshold', {_T}"))
def p12_report_summary_standin(inp):
    """Audit-export summary table on the stand-in score, with the score's own AUC."""
    auc = metrics.ranking_metrics(inp.scored).first()["auc_roc"]
    return portfolio.report_summary_table(portfolio.top_risk_queue(inp.scored, inp.threshold), auc, inp.threshold)


_LOSS = " UNION ALL ".join(
    f"SELECT model, horizon, CAST({q} AS DOUBLE) AS quantile, round_even(avg(greatest({q} * (TARGET - {p}), ({q} - 1) * (TARGET - {p}))), 2) AS pinball_loss, "
    "count(*) AS n_test FROM tt GROUP BY ALL"
    for q, p in zip(FORECAST_QUANTILES, ("COLLECTIONS_LAG2", "ACTUAL_COLLECTIONS", "ACTUAL_COLLECTIONS * 1.2"), strict=True))


@precision({"pinball_loss": 1})
@register("m22_pinball_standin", O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, f"""t AS (
  SELECT *, row_number() OVER ({O._W_SLICE}) AS rn, count(*) OVER (PARTITION BY ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY) AS nn,
    lead(ACTUAL_COLLECTIONS, 1) OVER ({O._W_SLICE}) AS t30, lead(ACTUAL_COLLECTIONS, 2) OVER ({O._W_SLICE}) AS t60,
    lead(ACTUAL_COLLECTIONS, 3) OVER ({O._W_SLICE}) AS t90 FROM monthly WHERE ALL_INDUSTRY = 1)""",
    "tl AS (SELECT *, '30d' AS horizon, t30 AS TARGET FROM t UNION ALL SELECT *, '60d', t60 FROM t UNION ALL SELECT *, '90d', t90 FROM t)",
    "tt AS (SELECT *, coalesce(REGION, 'global') AS model FROM tl WHERE TARGET IS NOT NULL AND rn > floor(nn * 0.8))", select=_LOSS))
def m22_pinball_standin(inp):
    """Pinball loss per (slice, horizon, quantile) of quantiles from recent months on the last 20 % of months."""
    rows = monthly.horizon_targets(inp.monthly).where((F.col("ALL_INDUSTRY") == 1) & (F.col("split") == "test"))
    names = [forecast.qname(q) for q in FORECAST_QUANTILES]
    pred = rows.select(F.coalesce("REGION", F.lit("global")).alias("model"), F.col("HORIZON_DAYS").alias("horizon"), "TARGET",
                       F.col("COLLECTIONS_LAG2").alias(names[0]), F.col("ACTUAL_COLLECTIONS").alias(names[1]),
                       (F.col("ACTUAL_COLLECTIONS") * F.lit(1.2)).alias(names[2]))
    return forecast.pinball_table(pred, FORECAST_QUANTILES)


# ---- classifier inputs ---------------------------------------------------------------------------
@register("c2_c4_training_rows", O.rounded(O.with_prefix(*O.FS_CTES, O.SPLIT_CTE,
    "tr AS (SELECT *, row_number() OVER (ORDER BY BLDAT, BELNR) AS rn2, count(*) OVER () AS n2 FROM split WHERE split = 'train')",
    "v AS (SELECT *, rn2 > floor(n2 * 0.8) AS is_val FROM tr)",
    select="SELECT is_val, count(*) AS n_rows, CAST(sum(LATE_FLAG) AS BIGINT) AS n_late, min(BLDAT) AS first_date, max(BLDAT) AS last_date, "
    "round(count_if(LATE_FLAG = 0) / count_if(LATE_FLAG = 1), 2) AS positive_weight FROM v GROUP BY is_val"), ["positive_weight"]))
def c2_c4_training_rows(inp):
    """Rows, late rows, dates and class weight of the fitting and the validation rows."""
    from ..operators import classify

    cut = classify.validation_cut(inp.split.where(F.col("split") == "train").drop("split"))
    late = F.col("LATE_FLAG") == 1
    return cut.groupBy("is_val").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("LATE_FLAG").cast("long").alias("n_late"), F.min("BLDAT").alias("first_date"),
        F.max("BLDAT").alias("last_date"), F.round(F.count_if(~late) / F.count_if(late), 2).alias("positive_weight"))


@register("c3_fold_sizes", O.with_prefix(*O.FS_CTES, O.SPLIT_CTE,
    "n AS (SELECT CAST(LATE_FLAG AS INTEGER) AS label, count(*) AS n FROM split WHERE split = 'train' GROUP BY 1)",
    select="SELECT label, CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS n_rows FROM n, (SELECT unnest(range(5)) AS f)"))
def c3_fold_sizes(inp):
    """Rows per class and fold of the train split: exactly stratified."""
    from ..operators import classify

    folds = classify.stratified_folds(inp.split.where(F.col("split") == "train").drop("split"), 5)
    return folds.groupBy(F.col("LATE_FLAG").cast("int").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- rationale, data quality --------------------------------------------------------------------
@register("p25_feature_rationale", O.rounded(O.with_prefix(*O.FS_CTES,
    "tc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, '{portfolio.RATIONALE[c]}' AS rationale, corr(CAST({c} AS DOUBLE), LATE_FLAG) AS corr FROM fs" for c in FEATURE_COLS) + ")",
    select="SELECT row_number() OVER (ORDER BY abs(corr) DESC, feature) AS rank, feature, rationale, corr FROM tc"), ["corr"]))
def p25_feature_rationale(inp):
    """Every model feature with its reason and its correlation with the target."""
    return portfolio.feature_rationale(inp.feature_store)


@register("q10_overall", f"SELECT count_if(NOT passed) = 0 AS all_passed, count(*) AS n_rules FROM ({O.quality_sql()})")
def q10_overall(inp):
    """Overall validation flag and number of rules."""
    return quality.overall_passed(quality.validate_all(_quality_tables(inp)))


@register("q1_incomplete_inputs", O.with_prefix(select=(
    "SELECT 'customer_master' AS dataset, 'required_columns' AS rule, 'ERDAT' AS col_name, 1 AS n_bad, CAST(NULL AS BIGINT) AS n_rows, 'missing column' AS detail, false AS passed "
    "UNION ALL SELECT 'gl_cash_positions', 'file_present', NULL, 1, 0, 'missing input', false "
    "UNION ALL SELECT 'invoice_history', 'not_null', 'BELNR', count(*) - count(BELNR), count(*), NULL, count(*) = count(BELNR) FROM inv")))
def q1_incomplete_inputs(inp):
    """Report with a missing customer column and an absent GL table (and one rule of the invoices)."""
    tables = _quality_tables(inp)
    report = quality.validate_all({**tables, "customer_master": tables["customer_master"].drop("ERDAT"), "gl_cash_positions": None})
    return report.where("rule IN ('required_columns', 'file_present') OR (dataset = 'invoice_history' AND rule = 'not_null' AND col_name = 'BELNR')")


@register("q3_invalid_values", O.with_prefix(select=(
    "SELECT 'customer_master' AS dataset, 'BRSCH' AS col_name, BRSCH AS value, count(*) AS n_rows FROM cust WHERE BRSCH = 'ZZ' GROUP BY ALL "
    "UNION ALL SELECT 'customer_master', 'REGIO', REGIO, count(*) FROM cust WHERE REGIO = 'XX' GROUP BY ALL")))
def q3_invalid_values(inp):
    """Every distinct value of the four raw tables outside their code lists, with its rows."""
    return quality.all_invalid_values(_quality_tables(inp))


# ---- history without label look-ahead ------------------------------------------------------------
_ASOF = [
    "cl AS (SELECT BELNR, KUNNR, BLDAT, AUGDT, DAYS_LATE, LATE_FLAG FROM invn WHERE STATUS = 'CLEARED' AND KUNNR IS NOT NULL AND BLDAT IS NOT NULL)",
    "pr AS (SELECT i.BELNR AS b, j.DAYS_LATE, j.LATE_FLAG, row_number() OVER (PARTITION BY i.BELNR ORDER BY j.AUGDT DESC, j.BLDAT DESC, j.BELNR DESC) AS r "
    "FROM cl i JOIN cl j ON i.KUNNR = j.KUNNR AND j.AUGDT < i.BLDAT)",
    "st AS (SELECT b, avg(DAYS_LATE) AS a, avg(LATE_FLAG) AS l, avg(DAYS_LATE) FILTER (r <= 3) AS r3 FROM pr GROUP BY b)",
]


@register("f1_history_asof", O.rounded(O.with_prefix(*_ASOF, select=(
    "SELECT BELNR, coalesce(a, 0.0) AS CUST_AVG_DAYS_LATE, coalesce(l, 0.0) AS CUST_LATE_RATE, coalesce(r3, a, 0.0) AS CUST_ROLLING3_DAYS_LATE "
    "FROM cl LEFT JOIN st ON BELNR = b")), ["CUST_AVG_DAYS_LATE", "CUST_LATE_RATE", "CUST_ROLLING3_DAYS_LATE"]))
def f1_history_asof(inp):
    """Customer history from invoices cleared before the document's day (no label look-ahead)."""
    from ..operators import features

    cleared = inp.invoices.where(F.col("STATUS") == "CLEARED")
    return features.customer_history(cleared, asof=True).select("BELNR", "CUST_AVG_DAYS_LATE", "CUST_LATE_RATE", "CUST_ROLLING3_DAYS_LATE")


@register("m1_tier_asof", O.with_prefix(
    "cm AS (SELECT KUNNR, strftime(CASE WHEN STATUS = 'CLEARED' THEN AUGDT ELSE BLDAT END, '%Y-%m') AS COLLECT_MONTH, STATUS, sum(LATE_FLAG) AS late, "
    "count(LATE_FLAG) AS n FROM invn WHERE KUNNR IS NOT NULL GROUP BY ALL)",
    "e AS (SELECT a.KUNNR, a.COLLECT_MONTH, a.STATUS, sum(b.late) / nullif(sum(b.n), 0) AS rate FROM cm a LEFT JOIN cm b ON a.KUNNR = b.KUNNR "
    "AND b.STATUS = 'CLEARED' AND b.COLLECT_MONTH < a.COLLECT_MONTH GROUP BY ALL)",
    select=f"SELECT COLLECT_MONTH, RISK_TIER, count(*) AS n FROM (SELECT *, coalesce(CASE WHEN rate IS NOT NULL THEN {O.tier_sql('rate')} END, 'Medium') AS RISK_TIER FROM e) GROUP BY ALL"))
def m1_tier_asof(inp):
    """Customer-months per month and tier, where the tier knows only earlier months."""
    tiers = monthly.customer_tier(monthly.customer_months(inp.invoices), asof=True)
    return tiers.where("KUNNR IS NOT NULL").groupBy("COLLECT_MONTH", "RISK_TIER").agg(F.count(F.lit(1)).alias("n"))


# ---- one boosting round of all models, and the models that selections get ------------------------
_ROUND = boosting.BoostConfig(n_rounds=1, max_depth=1)
_ELIGIBLE = "SELECT REGION FROM monthly WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 GROUP BY REGION HAVING count(*) >= 24 AND sum(N_INVOICES_CLEARED) >= 250"
_KEY = "model, horizon, quantile"


def _quantile_of(value: str, source: str, more: str = "") -> str:
    """SELECT of the model key, ``more`` and the model's quantile ``x`` of ``value``."""
    return " UNION ALL ".join(f"SELECT model, horizon, CAST({q} AS DOUBLE) AS quantile{more}, quantile_cont({value}, {q}) AS x FROM {source} "
                              f"{'' if source == 'tr' else f'WHERE quantile = CAST({q} AS DOUBLE) '}GROUP BY ALL" for q in FORECAST_QUANTILES)


@precision({"start": 1, "cut": 4, "left_value": 1, "right_value": 1})
@register("m15_boosting_round_standin", O.with_prefix(
    *O.SCORED, *O.MONTHLY_CTES,
    f"t AS (SELECT *, lead(ACTUAL_COLLECTIONS, 1) OVER ({O._W_SLICE}) AS t30, lead(ACTUAL_COLLECTIONS, 2) OVER ({O._W_SLICE}) AS t60, "
    f"lead(ACTUAL_COLLECTIONS, 3) OVER ({O._W_SLICE}) AS t90 FROM monthly)",
    "tl AS (SELECT *, 30 AS horizon, t30 AS TARGET FROM t UNION ALL SELECT *, 60, t60 FROM t UNION ALL SELECT *, 90, t90 FROM t)",
    "tr AS (SELECT *, 'global' AS model, row_number() OVER () AS rid FROM tl WHERE TARGET IS NOT NULL AND ALL_REGION = 1 AND ALL_INDUSTRY = 1 "
    f"UNION ALL SELECT *, 'segment:' || REGION, -row_number() OVER () FROM tl WHERE TARGET IS NOT NULL AND ALL_REGION = 0 AND ALL_INDUSTRY = 1 AND REGION IN ({_ELIGIBLE}))",
    f"started AS ({_quantile_of('TARGET', 'tr')})",
    "g AS (SELECT tr.*, quantile, x AS start, (x >= TARGET)::INT AS over, TARGET - x AS residual FROM tr JOIN started USING (model, horizon))",
    f"tot AS (SELECT {_KEY}, any_value(start) AS start, count(*) AS n, sum(over) AS o FROM g GROUP BY ALL)",
    "long AS (" + " UNION ALL ".join(f"SELECT {_KEY}, rid, {i} AS f, '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) AS v, over, residual FROM g" for i, c in enumerate(FORECAST_FEATURE_COLS)) + ")",
    f"bins AS (SELECT {_KEY}, f, feature, v, sum(count(*)) OVER w AS nl, sum(sum(over)) OVER w AS ol FROM long GROUP BY {_KEY}, f, feature, v WINDOW w AS (PARTITION BY {_KEY}, f ORDER BY v))",
    "gains AS (SELECT *, round(power(ol - quantile * nl, 2) / nl + power((o - ol) - quantile * (n - nl), 2) / (n - nl) - power(o - quantile * n, 2) / n, 9) AS gain "
    f"FROM bins JOIN tot USING ({_KEY}) WHERE nl >= {_ROUND.min_rows} AND n - nl >= {_ROUND.min_rows})",
    f"split AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY gain DESC, f, v) AS rk FROM gains WHERE gain > 0) WHERE rk = 1)",
    f"side AS (SELECT {_KEY}, long.v <= split.v AS is_left, residual FROM long JOIN split USING ({_KEY}, f))",
    f"leaf AS ({_quantile_of('residual', 'side', ', is_left')})",
    select=f"SELECT model, horizon, quantile, tot.start, feature, split.v AS cut, nl::BIGINT AS n_left, (tot.n - nl)::BIGINT AS n_right, l.x * {_ROUND.step} AS left_value, r.x * {_ROUND.step} AS right_value "
    f"FROM tot LEFT JOIN split USING ({_KEY}) LEFT JOIN leaf l ON l.is_left AND l.model = tot.model AND l.horizon = tot.horizon AND l.quantile = tot.quantile "
    "LEFT JOIN leaf r ON NOT r.is_left AND r.model = tot.model AND r.horizon = tot.horizon AND r.quantile = tot.quantile"))
def m15_boosting_round_standin(inp):
    """Start value, split and leaf values of the first boosting round of every model, on all its months."""
    rows = forecast.model_rows(inp.monthly, monthly.segment_summary(inp.monthly))
    rows = rows.withColumns({"is_train": F.lit(True), **{c: F.round(F.col(c).cast("double"), 6) for c in FORECAST_FEATURE_COLS}})
    trees = stored(boosting.fit_models(rows, FORECAST_FEATURE_COLS, FORECAST_QUANTILES, _ROUND, tuple(forecast.ROW)), "boosting-round")
    bound = F.get("bounds", F.lit(0))
    is_left = (F.col("tree") == 1) & (bound["lower"] == float("-inf"))
    is_right = (F.col("tree") == 1) & (bound["upper"] == float("inf"))
    names = F.array(*[F.lit(c) for c in FORECAST_FEATURE_COLS])
    return trees.groupBy(*boosting.MODEL).agg(
        F.max(F.when(F.col("tree") == 0, F.col("value"))).alias("start"), F.max(F.get(names, bound["feature"])).alias("feature"),
        F.max(F.when(is_left, bound["upper"])).alias("cut"), F.max(F.when(is_left, F.col("n_rows"))).alias("n_left"),
        F.max(F.when(is_right, F.col("n_rows"))).alias("n_right"), F.max(F.when(is_left, F.col("value"))).alias("left_value"),
        F.max(F.when(is_right, F.col("value"))).alias("right_value"))


@register("m19_model_resolution", O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, _LAST,
    "asked AS (SELECT 'All' AS r, 'All' AS i UNION ALL SELECT REGION, 'All' FROM lastrow WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 "
    f"UNION ALL SELECT '{MISSING}', 'All' UNION ALL SELECT 'All', INDUSTRY FROM lastrow WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 0 "
    "UNION ALL SELECT REGION, INDUSTRY FROM lastrow WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 0)",
    "own AS (SELECT r, i, months FROM asked LEFT JOIN lastrow ON (CASE WHEN r = 'All' THEN ALL_REGION = 1 ELSE ALL_REGION = 0 AND REGION = r END) "
    "AND (CASE WHEN i = 'All' THEN ALL_INDUSTRY = 1 ELSE ALL_INDUSTRY = 0 AND INDUSTRY = i END))",
    select="SELECT r AS Selected_Region, i AS Selected_Industry, CASE WHEN e.REGION IS NULL THEN 'global' ELSE 'segment:' || r END AS model, "
    "CASE WHEN e.REGION IS NULL THEN 'global' ELSE 'segment' END AS Model_Source, r AS Model_Segment, "
    "CASE WHEN r = 'All' AND i = 'All' THEN 'portfolio' WHEN coalesce(months, 0) >= 12 THEN 'selected slice' "
    "ELSE 'portfolio (fallback: selected slice has ' || coalesce(months, 0) || ' months < 12)' END AS Inference_Slice, "
    "CASE WHEN (r = 'All' AND i = 'All') OR coalesce(months, 0) < 12 THEN 1 ELSE (r = 'All')::INT END AS ALL_REGION "
    f"FROM own LEFT JOIN ({_ELIGIBLE}) e ON e.REGION = r"))
def m19_model_resolution(inp):
    """Which models and which series every selection of region and industry is forecast with."""
    flat = inp.monthly.select(*monthly.SLICE).distinct().collect()  # one row per slice
    value = lambda r, c: None if r[f"ALL_{c}"] == 1 else r[c]
    asked = [(value(r, "REGION"), value(r, "INDUSTRY")) for r in flat] + [(MISSING, None)]
    summary = monthly.segment_summary(inp.monthly).withColumn("trained", F.col("eligible_for_segment_model"))
    chosen = forecast.resolve_models(forecast.selections(inp.spark, asked), summary)
    return forecast.latest_rows(inp.monthly, chosen).select(
        "Selected_Region", "Selected_Industry", "model", "Model_Source", "Model_Segment", "Inference_Slice", F.col("ALL_REGION").cast("int").alias("ALL_REGION"))


# ---- tables that are written and read again -------------------------------------------------------
def _folder(inp, name: str) -> str:
    return f"{tables_dir(inp.spark)}/{name}-{digest(inp.sf_dir)}"


@register("q10_measured_on_load", O.quality_sql())
def q10_measured_on_load(inp):
    """Every rule of the four raw tables, measured while they are written."""
    return quality.load_validated(_quality_tables(inp), _folder(inp, "loaded"))[1]


def _customer_lines(inp):
    """The customer master as lines of an export in which every tenth name has a line break and every tenth record is cut."""
    c = inp.customers_raw.select("KUNNR", "BUKRS", "NAME1", "LAND1", "REGIO", "BRSCH", "KTOKD", "ZTERM", "KLIMK", "ERDAT")
    broken = F.concat(F.lit('"'), F.col("NAME1"), F.lit("\nBranch, "), F.col("LAND1"), F.lit('"'))
    name = F.when(F.col("KUNNR") % 10 == 3, broken).otherwise(F.col("NAME1"))
    cells = [F.coalesce(x.cast("string"), F.lit("")) for x in (F.col("KUNNR"), F.col("BUKRS"), name, *[F.col(k) for k in c.columns[3:]])]
    whole, cut = F.concat_ws(",", *cells), F.concat_ws(",", *cells[:4])
    return c.select(F.when(F.col("KUNNR") % 10 == 7, cut).otherwise(whole).alias("value"))


@register("s1_quarantined_records", O.with_prefix(select=(
    "SELECT 'lines' AS mode, count_if(KUNNR % 10 NOT IN (3, 7)) AS n_good, count_if(KUNNR % 10 = 7) + 2 * count_if(KUNNR % 10 = 3) AS n_malformed, "
    "CAST(sum(KUNNR) FILTER (KUNNR % 10 NOT IN (3, 7)) AS BIGINT) AS key_sum, 0 AS n_two_lines, count_if(KUNNR % 10 = 7) + 2 * count_if(KUNNR % 10 = 3) AS n_in_report FROM cust "
    "UNION ALL SELECT 'multi_line', count_if(KUNNR % 10 <> 7), count_if(KUNNR % 10 = 7), CAST(sum(KUNNR) FILTER (KUNNR % 10 <> 7) AS BIGINT), "
    "count_if(KUNNR % 10 = 3), count_if(KUNNR % 10 = 7) FROM cust")))
def s1_quarantined_records(inp):
    """An export with open quotes, line breaks in quotes and cut records: rows that are read, records that are kept
    apart, and what the quality report says of them, by line and as multi-line text."""
    path = _folder(inp, "customers-export")
    _customer_lines(inp).write.mode("overwrite").text(path)
    out = None
    for mode in ("lines", "multi_line"):
        multi = mode == "multi_line"
        good, bad = erp.read_quarantined(inp.spark, path, "customer_master", multi, header=False)
        raw = erp.read_raw(inp.spark, path, "customer_master", multi, header=False, malformed=True)
        rule = quality.validate_table("customer_master", raw).where("rule = 'malformed_records'").select("n_bad").scalar()
        one = good.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n_good"), F.sum(F.col("KUNNR").cast("long")).alias("key_sum"),
                       F.count_if(F.col("NAME1").contains("\nBranch, ")).alias("n_two_lines"))
        one = one.withColumns({"n_malformed": bad.agg(F.count("record")).scalar(), "n_in_report": rule})
        out = one if out is None else out.unionByName(one)
    return out


@precision({"amount": 2})
@register("s5_splits_reread", O.with_prefix(*O.FS_CTES, O.SPLIT_CTE, select=(
    "SELECT split, count(*) AS n_rows, min(BLDAT) AS first_date, max(BLDAT) AS last_date, sum(DMBTR) AS amount, "
    "CAST(sum(LATE_FLAG) AS BIGINT) AS n_late, 35 AS n_columns FROM split GROUP BY split")))
def s5_splits_reread(inp):
    """The split-partitioned feature store, written and read again as train and test."""
    path = _folder(inp, "splits")
    erp.write_feature_store(inp.split, path)
    out = None
    for name, part in zip(("train", "test"), erp.load_splits(inp.spark, path), strict=True):
        one = part.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_rows"), F.min("BLDAT").alias("first_date"), F.max("BLDAT").alias("last_date"),
                       F.sum("DMBTR").alias("amount"), F.sum("LATE_FLAG").cast("long").alias("n_late"), F.lit(len(part.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@register("s6_risk_report_reread", O.narrative_sql((_BG,), lambda c: f"round({_phi(c)}, 7)", "top, bg"))
def s6_risk_report_reread(inp):
    """The risk report with its narratives of several lines, written as CSV and read again."""
    path = _folder(inp, "risk-report")
    report = x7_linear_risk_report(inp).withColumn("SHAP_VALUES", F.array(F.lit(0.0)))
    erp.write_risk_report(report, path, files=1)
    back = inp.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(F.col("BELNR").cast("long").alias("BELNR"), "NARRATIVE")


@precision({"DMBTR": 2, "LATE_PROB": 4})
@register("s7_flagged_reread", O.with_prefix(*O.SCORED, select=(
    f"SELECT {', '.join(erp.FLAGGED_COLS)} FROM scored WHERE LATE_PRED = 1")))
def s7_flagged_reread(inp):
    """The export of all flagged invoices, written as CSV and read again."""
    path = _folder(inp, "flagged")
    flagged = inp.scored.where("LATE_PRED = 1").select(*erp.FLAGGED_COLS)
    erp.write_flagged_invoices(flagged, path)
    return inp.spark.read.option("header", True).option("escape", '"').schema(flagged.schema).csv(path)


@register("f21_published_codes", O.with_prefix(*O.FS_CTES, select="SELECT BELNR, INDUSTRY, REGION, INDUSTRY_CODE, REGION_CODE FROM fs"))
def f21_published_codes(inp):
    """Category codes that were published with a version, found as the newest one and given to the features
    of all invoices."""
    folder = _folder(inp, "codes")
    models.save_codes(features.category_mapping(inp.feature_store), f"{folder}/v1")
    models.publish(inp.spark, f"{folder}/v1", {"kind": "codes", "codes": models.CODES})
    path, _ = models.latest(inp.spark, folder)
    plain = inp.feature_store.select("BELNR", "INDUSTRY", "REGION")
    return features.category_codes(plain, mapping=models.load_codes(inp.spark, path))


@register("s8_scores_of_published_model")
def s8_scores_of_published_model(inp):
    """The newest published model scores all invoices, their features made with its own codes."""
    inp.classifier  # noqa: B018  (published once per session)
    from ..operators import classify
    from ..session import models_dir

    model, codes = classify.TrainedClassifier.load_published(models_dir(inp.spark, "classifier", inp.sf_dir))
    scored = classify.score_invoices(model, codes, inp.customers, inp.invoices, inp.gl)
    return scored.select("BELNR", "INDUSTRY_CODE", "REGION_CODE", "LATE_PROB", "LATE_PRED", "RISK_LABEL")
