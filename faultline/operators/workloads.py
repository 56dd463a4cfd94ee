"""The analytical jobs that the triaged pipelines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultline.operators import ordered

DAY = 86_400


def last_touch(
    orders: DataFrame, sessions: DataFrame, days: int = 30
) -> DataFrame:
    """The latest session of the same user within ``days`` before each order.

    Orders without one drop out, as in an inner join.
    """
    touches = sessions.select(
        "user_id", F.col("session_ts").alias("_at"), F.col("session_id"), F.col("channel")
    )
    return ordered.asof_join(
        orders, touches, ["user_id"], "order_ts", "_at", ["session_id", "channel"], tie="session_id",
        tolerance_seconds=days * DAY,
    ).where("session_id IS NOT NULL")


def churn_daily(subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    """Cancelled subscriptions with their customer and the day they ended."""
    ended = subscriptions.where("status = 'canceled'")
    return ended.join(customers, "customer_id").withColumn("churn_date", F.to_date("canceled_at"))


def customer_spend(customers: DataFrame, sales: DataFrame) -> DataFrame:
    """Total spend per customer. Sales are summed before the join."""
    totals = sales.groupBy("customer_id").agg(F.sum("amount").alias("total_spend"))
    return customers.join(totals, "customer_id")


def daily_revenue(sales: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct orders and revenue per day."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return sales.groupBy(F.to_date("order_ts").alias("order_date")).agg(
        distinct(F.col("order_id")).alias("total_orders"), F.sum("amount").alias("gross_revenue")
    )


def safe_ratio(rows: DataFrame, numerator: str, denominator: str, name: str) -> DataFrame:
    """``numerator / denominator``, null where the divisor is zero."""
    return rows.withColumn(name, F.col(numerator) / F.nullif(denominator, F.lit(0)))


def monthly_cohorts(activity: DataFrame) -> DataFrame:
    """Active users by month of first activity and months since.

    Activity shrinks to one row per user and month before the first month is
    looked up.
    """
    months = activity.groupBy("user_id", F.trunc("ts", "month").alias("month")).agg(F.lit(1).alias("_one"))
    first = F.min("month").over(Window.partitionBy("user_id"))
    return (
        months.withColumn("cohort", first)
        .groupBy("cohort", F.months_between("month", "cohort").cast("int").alias("period"))
        .agg(F.count("*").alias("users"))
    )
