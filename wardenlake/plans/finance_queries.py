"""Cost, ROI and budget jobs over parts, suppliers, customers, orders and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import finance as fin
from wardenlake.plans.registry import derive, plain, query

# A project per part brand and type.
PROJECTS = """
SELECT concat(p_brand, '/', p_type) AS project,
       CASE p_type WHEN 'ECONOMY' THEN 'react-hooks' WHEN 'STANDARD' THEN 'python3' WHEN 'PROMO' THEN 'typescript' WHEN 'LARGE' THEN 'vue3' ELSE 'other' END AS migration_type,
       cast(count(*) AS int) AS file_count, cast(avg(p_size) AS double) AS complexity_score, cast(1 + max(p_size) % 5 AS int) AS team_size,
       CASE min(p_size) % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'OTHER' END AS risk_level
FROM {part} GROUP BY p_brand, p_type
"""
_P = plain(PROJECTS)
_COST = f"""
SELECT *, base + risk_mitigation_cost + contingency_cost AS total_cost FROM (
SELECT *, base * CASE risk_level WHEN 'LOW' THEN 0.1::DOUBLE WHEN 'HIGH' THEN 0.2::DOUBLE WHEN 'CRITICAL' THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END AS contingency_cost FROM (
SELECT *, development_cost * CASE risk_level WHEN 'LOW' THEN 0.05::DOUBLE WHEN 'HIGH' THEN 0.2::DOUBLE WHEN 'CRITICAL' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS risk_mitigation_cost,
  development_cost + testing_cost + infrastructure_cost + training_cost AS base FROM (
SELECT *, development_hours * 100 AS development_cost, development_hours * 0.3::DOUBLE AS testing_hours, development_hours * 0.3::DOUBLE * 100 AS testing_cost FROM (
SELECT *, file_count * (2 + complexity_score / 100 * 2) * CASE WHEN team_size > 1 THEN 1 + (team_size - 1) * 0.1::DOUBLE ELSE 1.0::DOUBLE END AS development_hours,
  CAST(500 + file_count * 10 + CASE migration_type WHEN 'react-hooks' THEN 300 WHEN 'vue3' THEN 300 WHEN 'typescript' THEN 250 ELSE 200 END AS DOUBLE) AS infrastructure_cost,
  CAST(team_size * 900 AS DOUBLE) AS training_cost FROM ({_P})))))"""
_NINE = ["development_hours", "development_cost", "testing_hours", "testing_cost", "infrastructure_cost", "training_cost",
         "risk_mitigation_cost", "contingency_cost", "total_cost"]


def _costs(spark, sf_dir):
    return fin.cost_breakdown(derive(spark, sf_dir, PROJECTS, "part"))


@query("cost_breakdown", f"SELECT project, {', '.join(f'round({c}, 4) AS {c}' for c in _NINE)} FROM ({_COST})")
def cost_breakdown(spark, sf_dir):
    return _costs(spark, sf_dir).select("project", *[F.round(c, 4).alias(c) for c in _NINE])


@query("cost_rollup", f"""
SELECT coalesce(migration_type, 'ALL') AS migration_type, coalesce(risk_level, 'ALL') AS risk_level, count(*) AS projects,
  round(sum(total_cost), 5) AS total_cost, round(avg(development_hours), 6) AS mean_hours FROM ({_COST}) GROUP BY ROLLUP (migration_type, risk_level)""")
def cost_rollup(spark, sf_dir):
    return fin.cost_rollup(_costs(spark, sf_dir)).withColumn("total_cost", F.round("total_cost", 5)).withColumn("mean_hours", F.round("mean_hours", 6))


ROLES = """
SELECT concat('p', cast(l_suppkey AS string)) AS project, l_returnflag AS role, l_quantity AS members, 50 + l_tax * 1000 AS hourly_rate,
       CASE WHEN l_linestatus = 'O' THEN 40.0 ELSE 20.0 END AS hours_per_week, cast(l_linenumber AS double) AS weeks FROM {lineitem}
"""


@query("team_cost", f"SELECT project, round(sum(members * hourly_rate * hours_per_week * weeks), 1) AS team_cost FROM ({plain(ROLES)}) GROUP BY project")
def team_cost(spark, sf_dir):
    return fin.team_cost(derive(spark, sf_dir, ROLES, "lineitem")).withColumn("team_cost", F.round(F.col("team_cost").cast("double"), 1))


MAINTENANCE = "SELECT s_suppkey, greatest(s_acctbal, 0.0) / 10 AS current_hours, s_nationkey * 1.0 AS projected_hours FROM {supplier}"


@query("savings", f"""
SELECT s_suppkey, round(CAST(c - p AS DOUBLE), 4) AS monthly_savings_hours, round(CAST((c - p) * 100 AS DOUBLE), 3) AS monthly_savings_cost,
  round(CAST((c - p) * 1200 AS DOUBLE), 2) AS total_savings, round(CASE WHEN c > 0 THEN (c - p) / c * 100 ELSE 0.0 END, 4) AS efficiency_gain_percentage
FROM (SELECT s_suppkey, CAST(current_hours AS DOUBLE) AS c, CAST(projected_hours AS DOUBLE) AS p FROM ({plain(MAINTENANCE)}))""")
def savings(spark, sf_dir):
    out = fin.savings(derive(spark, sf_dir, MAINTENANCE, "supplier").withColumn("projected_hours", F.col("projected_hours").cast("double")))
    scales = {"monthly_savings_hours": 4, "monthly_savings_cost": 3, "total_savings": 2, "efficiency_gain_percentage": 4}
    return out.select("s_suppkey", *[F.round(c, s).alias(c) for c, s in scales.items()])


# Three scenarios per customer, some without investment or benefit.
SCENARIOS = """
SELECT concat('n', cast(c_nationkey AS string), '-', c_mktsegment) AS project, concat('s', cast(c_custkey AS string)) AS name,
       CASE WHEN c_custkey % 50 = 0 THEN cast(0 AS double) ELSE 1000 + abs(c_acctbal) END AS investment,
       CASE WHEN c_custkey % 40 = 7 THEN cast(0 AS double) ELSE cast(10 + c_custkey % 300 AS double) END AS monthly_savings,
       CASE WHEN c_custkey % 40 = 7 THEN cast(0 AS double) ELSE cast(c_custkey % 100 AS double) END AS monthly_revenue_increase
FROM {customer}
"""
_ROI = f"""
SELECT *, benefit * f - investment AS npv, CASE WHEN investment > 0 THEN (benefit * 24 - investment) / investment * 100 ELSE 0.0 END AS roi_percentage,
  CASE WHEN benefit > 0 THEN investment / benefit ELSE 'inf'::DOUBLE END AS payback_months,
  CASE WHEN investment > 0 THEN benefit * 24 / investment ELSE 0.0 END AS cost_benefit_ratio,
  CASE WHEN investment > 0 THEN (benefit * 24 * 0.8::DOUBLE - investment) / investment * 100 ELSE 0.0 END AS risk_adjusted_roi
FROM (SELECT *, monthly_savings + monthly_revenue_increase AS benefit FROM ({plain(SCENARIOS)})),
     (SELECT sum(1 / pow(1 + 0.1::DOUBLE / 12, m)) AS f FROM range(1, 25) t(m))"""


def _roi(spark, sf_dir):
    return fin.roi_metrics(derive(spark, sf_dir, SCENARIOS, "customer"))


@query("roi_metrics", f"""
SELECT name, round(roi_percentage, 4) AS roi_percentage, round(payback_months, 6) AS payback_months, round(npv, 3) AS npv,
  round(cost_benefit_ratio, 6) AS cost_benefit_ratio, round(risk_adjusted_roi, 4) AS risk_adjusted_roi FROM ({_ROI})""")
def roi_metrics(spark, sf_dir):
    scales = {"roi_percentage": 4, "payback_months": 6, "npv": 3, "cost_benefit_ratio": 6, "risk_adjusted_roi": 4}
    return _roi(spark, sf_dir).select("name", *[F.round(c, s).alias(c) for c, s in scales.items()])


@query("roi_npv", f"""
SELECT name, round(sum(benefit / pow(1 + 0.1::DOUBLE / 12, m)) - max(investment), 3) AS npv FROM ({_ROI}), range(1, 25) t(m) GROUP BY name""")
def roi_npv(spark, sf_dir):
    flows = fin.cash_flows(derive(spark, sf_dir, SCENARIOS, "customer"))
    return flows.groupBy("name").agg(F.round(F.sum("discounted") - F.max("investment"), 3).alias("npv"))


@query("scenario_rank", f"""
SELECT project, name, row_number() OVER (PARTITION BY project ORDER BY score DESC, name) AS rank FROM (
  SELECT project, name, round(0.4::DOUBLE * least(roi_percentage / 100, 2.0) + 0.3::DOUBLE * greatest(0.0, 1 - payback_months / 24)
    + 0.3::DOUBLE * greatest(0.0, npv / greatest(investment, 1.0)), 9) AS score FROM ({_ROI}))""")
def scenario_rank(spark, sf_dir):
    return fin.scenario_ranking(_roi(spark, sf_dir)).select("project", "name", "rank")


@query("roi_bands", f"""
SELECT CASE WHEN roi_percentage >= 100 THEN 'Excellent' WHEN roi_percentage >= 50 THEN 'Strong' WHEN roi_percentage >= 20 THEN 'Good' WHEN roi_percentage > 0 THEN 'Modest' ELSE 'Negative' END AS roi_band,
  CASE WHEN payback_months <= 6 THEN 'Fast' WHEN payback_months <= 12 THEN 'Reasonable' WHEN payback_months <= 24 THEN 'Moderate' ELSE 'Long' END AS payback_band,
  CASE WHEN npv > 0 THEN 'Positive' ELSE 'Negative' END AS npv_band, count(*) AS scenarios FROM ({_ROI}) GROUP BY ALL""")
def roi_bands(spark, sf_dir):
    return fin.interpretation(_roi(spark, sf_dir)).groupBy("roi_band", "payback_band", "npv_band").agg(F.count("*").alias("scenarios"))


# A budget per customer, an expense per order, the category by order priority.
BUDGETS = """
SELECT c_custkey AS plan_id, 200000 + abs(c_acctbal) * 400 AS total_budget, cast('1995-01-01' AS timestamp) AS created FROM {customer}
"""
_CATEGORY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Development' WHEN '2-HIGH' THEN 'Testing' WHEN '3-MEDIUM' THEN 'Infrastructure'
  WHEN '4-NOT SPECIFIED' THEN 'Training' ELSE 'Contingency' END"""
EXPENSES = "SELECT o_custkey AS plan_id, " + _CATEGORY + " AS category, o_totalprice AS amount, o_orderdate AS ts FROM {orders}"
AS_OF = "2001-12-31"
_ITEMS = f"""
SELECT p.plan_id, p.total_budget, c.category, p.total_budget * 0.85::DOUBLE / 6 AS estimated_cost, e.spent
FROM ({plain(BUDGETS)}) p CROSS JOIN (SELECT unnest({fin.CATEGORIES!r}) AS category) c
LEFT JOIN (SELECT plan_id, category, sum(amount) AS spent FROM ({plain(EXPENSES)}) GROUP BY ALL) e ON e.plan_id = p.plan_id AND e.category = c.category"""
_POSTED = f"""
SELECT *, coalesce(spent, 0.0) AS actual_cost, coalesce(spent, 0.0) - estimated_cost AS variance,
  CASE WHEN spent IS NULL THEN 'PLANNED' WHEN spent - estimated_cost > estimated_cost * 0.2::DOUBLE THEN 'OVER_BUDGET' WHEN spent > estimated_cost THEN 'WARNING' ELSE 'ON_TRACK' END AS status
FROM ({_ITEMS})"""
_SUMMARY = f"""
SELECT *, total_budget - spent_to_date AS remaining_budget, spent_to_date / total_budget AS utilization, spent_to_date / 2556 AS daily_burn_rate,
  CASE WHEN spent_to_date > total_budget THEN 'OVER_BUDGET' WHEN over_items > 0 THEN 'AT_RISK' WHEN warning_items > 0 THEN 'WARNING'
       WHEN spent_to_date / total_budget >= 0.9 THEN 'NEAR_LIMIT' WHEN spent_to_date / total_budget >= 0.75 THEN 'ON_TRACK' ELSE 'HEALTHY' END AS status
FROM (SELECT plan_id, max(total_budget) AS total_budget, sum(actual_cost) AS spent_to_date, count(*) FILTER (status = 'OVER_BUDGET') AS over_items,
        count(*) FILTER (status = 'WARNING') AS warning_items FROM ({_POSTED}) GROUP BY plan_id)"""


def _posted(spark, sf_dir):
    items = fin.allocate_budget(derive(spark, sf_dir, BUDGETS, "customer"))
    return fin.post_expenses(items, derive(spark, sf_dir, EXPENSES, "orders"), ["plan_id", "category"])


def _summary(spark, sf_dir):
    return fin.budget_summary(_posted(spark, sf_dir), F.lit(AS_OF).cast("date"))


@query("budget_items", f"""
SELECT plan_id, category, round(estimated_cost, 3) AS estimated_cost, round(actual_cost, 2) AS actual_cost, round(variance, 2) AS variance, status FROM ({_POSTED})""")
def budget_items(spark, sf_dir):
    return _posted(spark, sf_dir).select("plan_id", "category", F.round("estimated_cost", 3).alias("estimated_cost"), F.round("actual_cost", 2).alias("actual_cost"),
                                         F.round("variance", 2).alias("variance"), "status")


@query("budget_status", f"""
SELECT plan_id, round(spent_to_date, 2) AS spent_to_date, round(utilization, 6) AS budget_utilization, round(daily_burn_rate, 4) AS daily_burn_rate,
  round(CASE WHEN spent_to_date > 0 THEN remaining_budget / greatest(daily_burn_rate, 1.0) ELSE 0.0 END, 2) AS projected_days_remaining, status FROM ({_SUMMARY})""")
def budget_status(spark, sf_dir):
    scales = {"spent_to_date": 2, "budget_utilization": 6, "daily_burn_rate": 4, "projected_days_remaining": 2}
    return _summary(spark, sf_dir).select("plan_id", *[F.round(c, s).alias(c) for c, s in scales.items()], "status")


@query("budget_forecast", f"""
SELECT plan_id, CAST(m AS INT) AS month, round(spent_to_date + b * m, 4) AS cumulative_spend, round(greatest(0.0, total_budget - (spent_to_date + b * m)), 4) AS projected_remaining,
  CASE WHEN spent_to_date + b * 6 > total_budget THEN 'CRITICAL' WHEN b > 0 AND remaining_budget / b < 3 THEN 'WARNING' WHEN b > 0 AND remaining_budget / b < 6 THEN 'CAUTION' ELSE 'SUFFICIENT' END AS advice
FROM (SELECT *, spent_to_date / (2556 / 30) AS b FROM ({_SUMMARY})), range(1, 7) t(m)""")
def budget_forecast(spark, sf_dir):
    out = fin.forecast(_summary(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return out.select("plan_id", "month", F.round("cumulative_spend", 4).alias("cumulative_spend"), F.round("projected_remaining", 4).alias("projected_remaining"), "advice")


@query("budget_compare", f"SELECT plan_id, round(spent_to_date, 2) AS spent_to_date, round(utilization, 6) AS utilization FROM ({_SUMMARY})")
def budget_compare(spark, sf_dir):
    return fin.compare_budgets(_summary(spark, sf_dir)).select("plan_id", F.round("spent_to_date", 2).alias("spent_to_date"), F.round("utilization", 6).alias("utilization"))


@query("budget_totals", f"""
SELECT round(sum(total_budget), 0) AS total_combined_budget, round(sum(spent_to_date), 0) AS total_combined_spent, round(avg(utilization), 6) AS average_utilization FROM ({_SUMMARY})""")
def budget_totals(spark, sf_dir):
    t = fin.combined_totals(_summary(spark, sf_dir))
    return t.select(F.round("total_combined_budget", 0).alias("total_combined_budget"), F.round("total_combined_spent", 0).alias("total_combined_spent"),
                    F.round("average_utilization", 6).alias("average_utilization"))


@query("budget_running_variance", f"""
SELECT e.plan_id, e.category, e.day, round(sum(e.amount) OVER (PARTITION BY e.plan_id, e.category ORDER BY e.day) - i.estimated_cost, 4) AS variance
FROM (SELECT plan_id, category, CAST(ts AS DATE) AS day, sum(amount) AS amount FROM ({plain(EXPENSES)}) GROUP BY ALL) e
JOIN ({_ITEMS}) i ON i.plan_id = e.plan_id AND i.category = e.category""")
def budget_running_variance(spark, sf_dir):
    items = fin.allocate_budget(derive(spark, sf_dir, BUDGETS, "customer"))
    out = fin.running_variance(derive(spark, sf_dir, EXPENSES, "orders"), items, ["plan_id", "category"])
    return out.select("plan_id", "category", "day", F.round("variance", 4).alias("variance"))


PROGRESS = """
SELECT o_custkey AS project, count(*) AS total_files, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS completed_files,
       CASE o_custkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, max(o_totalprice) > 490000 AS over_budget
FROM {orders} GROUP BY o_custkey
"""


def _texts(pairs, name: str) -> str:
    """The texts whose condition holds, in order, as one string."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {condition} THEN '{text}' END" for condition, text in pairs) + f") AS {name}"


@query("executive_rollup", f"""
SELECT project, round(progress_percentage, 4) AS progress_percentage,
  CASE WHEN risk_level = 'CRITICAL' THEN 'AT_RISK' WHEN progress_percentage >= 100 THEN 'COMPLETED' WHEN progress_percentage >= 75 THEN 'NEAR_COMPLETION'
    WHEN progress_percentage >= 50 THEN 'IN_PROGRESS' WHEN progress_percentage >= 25 THEN 'UNDERWAY' ELSE 'STARTED' END AS overall_status,
  {_texts([(f"progress_percentage >= {limit}", text) for limit, text in fin.MILESTONES], "milestones")},
  {_texts(fin.ADVICE, "recommendations")},
  replace({_texts(fin.NEXT_STEPS, "x")[:-5]}, '{{progress}}', tenth) AS next_steps
FROM (SELECT *, completed_files / total_files * 100 AS progress_percentage, printf('%.1f', completed_files / total_files * 100) AS tenth FROM ({plain(PROGRESS)}))""")
def executive_rollup(spark, sf_dir):
    out = fin.executive_rollup(derive(spark, sf_dir, PROGRESS, "orders"))
    return out.select("project", F.round("progress_percentage", 4).alias("progress_percentage"), "overall_status",
                      *[F.array_join(c, "; ").alias(c) for c in ("milestones", "recommendations", "next_steps")])
