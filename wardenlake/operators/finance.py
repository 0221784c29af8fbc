"""Cost, return-on-investment and budget jobs over project, scenario and expense tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.functions.windows import number_rows

# Rates by risk level and infrastructure cost by migration type.
RISK_RATE = {"LOW": 0.05, "MEDIUM": 0.1, "HIGH": 0.2, "CRITICAL": 0.3}
CONTINGENCY_RATE = {"LOW": 0.1, "MEDIUM": 0.15, "HIGH": 0.2, "CRITICAL": 0.25}
TYPE_COST = {"react-hooks": 300, "vue3": 300, "python3": 200, "typescript": 250}
DEFAULT_RISK_RATE, DEFAULT_CONTINGENCY, DEFAULT_TYPE_COST = 0.1, 0.15, 200
CATEGORIES = ["Development", "Testing", "Infrastructure", "Training", "Risk Mitigation", "Contingency"]
ALLOCATED, RESERVE = 0.85, 0.15


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.coalesce(table[key], F.lit(default))


def cost_breakdown(projects: DataFrame, hourly_rate: float = 100.0) -> DataFrame:
    """Nine cost columns per project, one narrow projection."""
    team, files = F.col("team_size"), F.col("file_count")
    hours = files * (2 + F.col("complexity_score") / 100 * 2) * F.when(team > 1, 1 + (team - 1) * 0.1).otherwise(1.0)
    return (
        projects.withColumn("development_hours", hours)
        .withColumn("development_cost", F.col("development_hours") * hourly_rate)
        .withColumn("testing_hours", F.col("development_hours") * 0.3)
        .withColumn("testing_cost", F.col("testing_hours") * hourly_rate)
        .withColumn("infrastructure_cost", 500.0 + files * 10 + _lookup(TYPE_COST, F.col("migration_type"), DEFAULT_TYPE_COST))
        .withColumn("training_cost", team * 8 * hourly_rate + team * 100)
        .withColumn("risk_mitigation_cost", F.col("development_cost") * _lookup(RISK_RATE, F.col("risk_level"), DEFAULT_RISK_RATE))
        .withColumn("_base", F.col("development_cost") + F.col("testing_cost") + F.col("infrastructure_cost") + F.col("training_cost"))
        .withColumn("contingency_cost", F.col("_base") * _lookup(CONTINGENCY_RATE, F.col("risk_level"), DEFAULT_CONTINGENCY))
        .withColumn("total_cost", F.col("_base") + F.col("risk_mitigation_cost") + F.col("contingency_cost"))
        .drop("_base"))


def cost_rollup(costs: DataFrame) -> DataFrame:
    return (costs.rollup("migration_type", "risk_level").agg(
        F.count("*").alias("projects"), F.sum("total_cost").alias("total_cost"), F.avg("development_hours").alias("mean_hours"))
        .select(F.coalesce("migration_type", F.lit("ALL")).alias("migration_type"), F.coalesce("risk_level", F.lit("ALL")).alias("risk_level"),
                "projects", "total_cost", "mean_hours"))


def team_cost(roles: DataFrame) -> DataFrame:
    return roles.groupBy("project").agg(F.sum(F.col("members") * F.col("hourly_rate") * F.col("hours_per_week") * F.col("weeks")).alias("team_cost"))


def savings(maintenance: DataFrame, hourly_rate: float = 100.0, months: int = 12) -> DataFrame:
    saved = F.col("current_hours") - F.col("projected_hours")
    return (maintenance.withColumn("monthly_savings_hours", saved).withColumn("monthly_savings_cost", saved * hourly_rate)
            .withColumn("total_savings", saved * hourly_rate * months)
            .withColumn("efficiency_gain_percentage", F.when(F.col("current_hours") > 0, saved / F.col("current_hours") * 100).otherwise(0.0)))


def npv(investment: Column, monthly: Column, months: int, discount_rate: float) -> Column:
    """Discounted cash flow: -I + Σ cash / (1 + r/12)^m."""
    step = 1 + discount_rate / 12
    factor = sum(1 / step ** m for m in range(1, months + 1))
    return monthly * F.lit(factor) - investment


def roi_metrics(scenarios: DataFrame, months: int = 24, discount_rate: float = 0.1) -> DataFrame:
    cost = F.col("investment")
    benefit = F.col("monthly_savings") + F.col("monthly_revenue_increase")
    returns = benefit * months
    payback = F.when(benefit > 0, cost / benefit).otherwise(F.lit(float("inf")))

    def ratio(value: Column) -> Column:
        return F.when(cost > 0, value).otherwise(0.0)

    return (scenarios.withColumn("monthly_benefit", benefit).withColumn("total_returns", returns)
            .withColumn("roi_percentage", ratio((returns - cost) / cost * 100)).withColumn("payback_months", payback)
            .withColumn("npv", npv(cost, benefit, months, discount_rate)).withColumn("cost_benefit_ratio", ratio(returns / cost))
            .withColumn("risk_adjusted_roi", ratio((returns * 0.8 - cost) / cost * 100)))


def cash_flows(scenarios: DataFrame, months: int = 24, discount_rate: float = 0.1) -> DataFrame:
    """One row per scenario and month."""
    benefit = F.col("monthly_savings") + F.col("monthly_revenue_increase")
    rows = scenarios.select("*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    return rows.withColumn("cash", benefit).withColumn("discounted", benefit / F.pow(F.lit(1 + discount_rate / 12), F.col("month")))


def rank_score() -> Column:
    roi = F.least(F.col("roi_percentage") / 100, F.lit(2.0))
    payback = F.greatest(F.lit(0.0), 1 - F.col("payback_months") / 24)
    value = F.greatest(F.lit(0.0), F.col("npv") / F.greatest(F.col("investment"), F.lit(1.0)))
    return roi * 0.4 + payback * 0.3 + value * 0.3


def scenario_ranking(metrics: DataFrame) -> DataFrame:
    """Best first within each project.

    A project with a large share of all scenarios is ranked in score bands of 0.001,
    whose counts are carried over, instead of in one window.
    """
    scored = metrics.withColumn("rank_score", F.round(rank_score(), 9)).withColumn("_worst_first", -F.col("rank_score"))
    ranked = number_rows(scored, ["project"], ["_worst_first", "name"], F.floor(F.col("_worst_first") * 1000), "rank")
    return ranked.drop("_worst_first")


def interpretation(metrics: DataFrame) -> DataFrame:
    roi, payback = F.col("roi_percentage"), F.col("payback_months")
    return (metrics.withColumn("roi_band", F.when(roi >= 100, "Excellent").when(roi >= 50, "Strong").when(roi >= 20, "Good").when(roi > 0, "Modest").otherwise("Negative"))
            .withColumn("payback_band", F.when(payback <= 6, "Fast").when(payback <= 12, "Reasonable").when(payback <= 24, "Moderate").otherwise("Long"))
            .withColumn("npv_band", F.when(F.col("npv") > 0, "Positive").otherwise("Negative")))


def allocate_budget(plans: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """85 % split evenly over the categories; the reserve stays on the plan."""
    names = categories or CATEGORIES
    items = F.posexplode(F.array(*[F.lit(c) for c in names]))
    return (plans.select("plan_id", "total_budget", "created", items.alias("item_index", "category"))
            .withColumn("estimated_cost", F.col("total_budget") * ALLOCATED / len(names))
            .withColumn("contingency_reserve", F.col("total_budget") * RESERVE))


def post_expenses(items: DataFrame, expenses: DataFrame, keys: list[str]) -> DataFrame:
    """Actual cost, variance and status per item; expenses are summed before the join."""
    spent = expenses.groupBy(*keys).agg(F.sum("amount").alias("_spent"))
    posted = items.join(spent, keys, "left")
    actual, variance = F.coalesce(F.col("_spent"), F.lit(0.0)), F.col("variance")
    return (posted.withColumn("actual_cost", actual).withColumn("variance", actual - F.col("estimated_cost"))
            .withColumn("status", F.when(F.col("_spent").isNull(), "PLANNED").when(variance > F.col("estimated_cost") * 0.2, "OVER_BUDGET")
                        .when(variance > 0, "WARNING").otherwise("ON_TRACK")).drop("_spent"))


def budget_summary(posted: DataFrame, as_of: Column) -> DataFrame:
    """Utilisation, burn, days left and status per plan."""
    per = posted.groupBy("plan_id").agg(
        F.first("total_budget").alias("total_budget"), F.first("created").alias("created"), F.sum("actual_cost").alias("spent_to_date"),
        F.sum((F.col("status") == "OVER_BUDGET").cast("int")).alias("over_items"), F.sum((F.col("status") == "WARNING").cast("int")).alias("warning_items"))
    spent, total = F.col("spent_to_date"), F.col("total_budget")
    days = F.greatest(F.datediff(as_of, F.col("created")), F.lit(1))
    burn = F.when(spent > 0, spent / days).otherwise(0.0)
    return (per.withColumn("remaining_budget", total - spent)
            .withColumn("budget_utilization", F.when(total > 0, spent / total).otherwise(0.0))
            .withColumn("daily_burn_rate", burn)
            .withColumn("projected_days_remaining", F.when(spent > 0, F.col("remaining_budget") / F.greatest(burn, F.lit(1.0))).otherwise(0.0))
            .withColumn("status", budget_status()))


def budget_status() -> Column:
    used = F.col("budget_utilization")
    return (F.when(F.col("spent_to_date") > F.col("total_budget"), "OVER_BUDGET").when(F.col("over_items") > 0, "AT_RISK")
            .when(F.col("warning_items") > 0, "WARNING").when(used >= 0.9, "NEAR_LIMIT").when(used >= 0.75, "ON_TRACK").otherwise("HEALTHY"))


def forecast(summary: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    """Projection per plan and month."""
    elapsed = F.datediff(as_of, F.col("created")) / 30
    total, spent = F.col("total_budget"), F.col("spent_to_date")
    burn = F.when(elapsed > 0, spent / elapsed).otherwise(total / 6)
    rows = (summary.withColumn("monthly_burn_rate", burn)
            .withColumn("depletion_months", F.when(F.col("monthly_burn_rate") > 0, F.col("remaining_budget") / F.col("monthly_burn_rate")).otherwise(F.lit(float("inf"))))
            .withColumn("budget_exceeded", spent + F.col("monthly_burn_rate") * months > total)
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month")))
    cumulative = spent + F.col("monthly_burn_rate") * F.col("month")
    return (rows.withColumn("cumulative_spend", cumulative).withColumn("projected_remaining", F.greatest(F.lit(0.0), total - cumulative))
            .withColumn("advice", F.when(F.col("budget_exceeded"), "CRITICAL").when(F.col("depletion_months") < 3, "WARNING")
                        .when(F.col("depletion_months") < 6, "CAUTION").otherwise("SUFFICIENT")))


def compare_budgets(summary: DataFrame) -> DataFrame:
    return summary.select("plan_id", "total_budget", "spent_to_date", "remaining_budget", F.col("budget_utilization").alias("utilization")).orderBy(
        F.desc("utilization"), "plan_id")


def combined_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.sum("total_budget").alias("total_combined_budget"), F.sum("spent_to_date").alias("total_combined_spent"),
                       F.coalesce(F.avg("budget_utilization"), F.lit(0.0)).alias("average_utilization"))


def running_variance(expenses: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of each item after every posting day.

    Postings are summed per day first, so a window group has at most one row per
    day however many postings an item gets.
    """
    daily = expenses.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("amount").alias("amount"))
    order = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = daily.withColumn("actual_cost", F.sum("amount").over(order))
    return running.join(items.select(*keys, "estimated_cost"), keys).withColumn("variance", F.col("actual_cost") - F.col("estimated_cost"))


# Milestone limits in percent.
MILESTONES = [(10, "Project kickoff completed"), (25, "First migration wave completed"), (50, "Halfway point reached"),
              (75, "Three-quarters completion"), (100, "Migration completed")]
# Condition on a project, advice.
RISKY = "risk_level IN ('HIGH', 'CRITICAL')"
ADVICE = [
    ("progress_percentage < 25", "Continue with pilot migration to validate approach"),
    ("progress_percentage < 25", "Set up comprehensive monitoring before scaling"),
    ("progress_percentage >= 25 AND progress_percentage < 50", "Review progress and adjust timeline if needed"),
    ("progress_percentage >= 25 AND progress_percentage < 50", "Ensure rollback capabilities are tested"),
    ("progress_percentage >= 50 AND progress_percentage < 75", "Focus on completing core functionality migration"),
    ("progress_percentage >= 50 AND progress_percentage < 75", "Begin planning for production deployment"),
    ("progress_percentage >= 75", "Prepare for production deployment"),
    ("progress_percentage >= 75", "Conduct final testing and validation"),
    (RISKY, "Implement additional risk mitigation strategies"),
    (RISKY, "Consider phased rollout approach"),
    ("over_budget", "Review budget and identify cost optimization opportunities"),
]
# Condition on a project, next step; the first one names the progress.
NEXT_STEPS = [
    ("progress_percentage < 100", "Continue migration (currently at {progress}%)"),
    (RISKY, "Address high-priority risks"),
    ("progress_percentage >= 75", "Prepare production deployment plan"),
]


def executive_rollup(projects: DataFrame) -> DataFrame:
    """Progress, status, milestones, advice and next steps per project (total_files, completed_files, risk_level, over_budget)."""
    done = F.col("completed_files") / F.greatest("total_files", F.lit(1)) * 100
    p = F.col("progress_percentage")

    def texts(pairs: list[tuple[Column, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(condition, text) for condition, text in pairs]))

    progress = F.format_string("%.1f", F.bround(p, 1))
    return (projects.withColumn("progress_percentage", done)
            .withColumn("overall_status", F.when(F.col("risk_level") == "CRITICAL", "AT_RISK").when(p >= 100, "COMPLETED").when(p >= 75, "NEAR_COMPLETION")
                        .when(p >= 50, "IN_PROGRESS").when(p >= 25, "UNDERWAY").otherwise("STARTED"))
            .withColumn("milestones", texts([(p >= limit, F.lit(text)) for limit, text in MILESTONES]))
            .withColumn("recommendations", texts([(F.expr(condition), F.lit(text)) for condition, text in ADVICE]))
            .withColumn("next_steps", texts([(F.expr(condition), F.replace(F.lit(text), F.lit("{progress}"), progress)) for condition, text in NEXT_STEPS])))
