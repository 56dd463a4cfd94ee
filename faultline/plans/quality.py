"""Queries on data quality and on the jobs being triaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import quality as ops
from faultline.operators import workloads
from faultline.plans import derived
from faultline.plans.registry import query

TASK = ["cluster", "dag_id", "task_id"]

derived.DERIVED["deliveries"] = """
SELECT event_id, dag_id, ts, CASE WHEN event_id % 37 IN (0, 1, 2, 3) THEN 0 ELSE cast(floor(value * 100) AS bigint) END AS rows
FROM {runs_base}
"""

derived.DERIVED["results"] = """
SELECT run_id, cluster AS project, CASE state WHEN 'failed' THEN 'error' ELSE 'success' END AS status, value,
  CASE WHEN state = 'failed' THEN CASE event_id % 3 WHEN 0 THEN '42703' WHEN 1 THEN '22012' ELSE '57014' END END AS code,
  CASE WHEN event_id % 4 = 0 THEN 'OK created model' ELSE 'Database Error in model m (models/marts/m_' || cast(user_id AS string)
    || '.sql)' || chr(10) || '  column "a" does not exist' END AS message
FROM {task_runs}
"""


@query(
    "duplicate_keys",
    """SELECT user_id, event_type, day, count(*) AS count FROM (
         SELECT user_id, event_type, substr(cast(ts AS string), 1, 10) AS day FROM {events}) e
       GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    day = F.substring(F.col("ts").cast("string"), 1, 10).alias("day")
    return ops.duplicate_keys(t.events.select("user_id", "event_type", day), ["user_id", "event_type", "day"])


@query(
    "column_tests",
    """WITH u AS (SELECT 'unique' AS test, 'o_orderkey' AS "column", (SELECT count(*) FROM (SELECT o_orderkey FROM {orders}
           WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1) x) AS failures
         UNION ALL SELECT 'unique', 'o_custkey', (SELECT count(*) FROM (SELECT o_custkey FROM {orders}
           WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1) x)
         UNION ALL SELECT 'not_null', 'o_orderkey', (SELECT count(*) FROM {orders} WHERE o_orderkey IS NULL)
         UNION ALL SELECT 'not_null', 'late_status', (SELECT count(*) FROM {orders} WHERE nullif(o_orderstatus, 'P') IS NULL))
       SELECT *, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM u""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("late_status"))
    return ops.column_tests(rows, ["o_orderkey", "o_custkey"], ["o_orderkey", "late_status"])


def _history(relation: str, keys: str, taken: str, n: int, value: str) -> str:
    """SQL: every row with the last n rows before it that were taken, found by their ordinals."""
    names = keys.split(", ")
    return f"""WITH r AS (SELECT *, count(*) FILTER (WHERE {taken}) OVER (PARTITION BY {keys} ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {{{relation}}}),
           h AS (SELECT {', '.join(f'{k} AS h_{k}' for k in names)}, before + 1 AS ord, {value} AS h_value FROM r WHERE {taken}),
           b AS (SELECT event_id, count(h_value) AS n, avg(h_value) AS m, stddev_samp(h_value) AS s, arg_max(h_value, ord) AS l
             FROM r LEFT JOIN h ON {' AND '.join(f'{k} = h_{k}' for k in names)} AND ord BETWEEN before - {n - 1} AND before
             GROUP BY event_id)
    """


@query(
    "success_baseline",
    _history("task_runs", "cluster, dag_id, task_id", "state = 'success'", 5, "value")
    + """SELECT run_id, state, n AS base_n, round(m, 6) AS base_mean, round(s, 6) AS base_std, l AS base_last,
           round((value - m) / nullif(s, 0), 4) + 0.0 AS z_score FROM r JOIN b USING (event_id)""",
)
def _(t):
    runs = t.task_runs.select(*TASK, "ts", "event_id", "run_id", "state", "value")
    rows = ops.success_baseline(runs, TASK, "ts", "event_id", "value")
    return rows.select(
        "run_id", "state", "base_n", F.round("base_mean", 6).alias("base_mean"), F.round("base_std", 6).alias("base_std"),
        "base_last", (F.round("z_score", 4) + 0.0).alias("z_score"),
    )


@query(
    "volume_anomalies",
    _history("deliveries", "dag_id", "rows > 0", 5, "rows")
    + """SELECT event_id, rows, CASE WHEN rows = 0 THEN 'ZERO_ROWS' WHEN n >= 3 AND abs(rows - m) > 2 * s THEN 'OUT_OF_RANGE' ELSE 'OK' END AS verdict
         FROM r JOIN b USING (event_id)""",
)
def _(t):
    return ops.volume_contract(t.deliveries, ["dag_id"], "ts", "event_id").select("event_id", "rows", "verdict")


@query(
    "volume_tolerance",
    _history("deliveries", "dag_id", "rows BETWEEN 1 AND 25000", 3, "rows")
    + """SELECT event_id, CASE WHEN rows = 0 THEN 'ZERO_ROWS' WHEN n >= 1 AND abs(rows - m) > 15000 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS verdict
         FROM r JOIN b USING (event_id)""",
)
def _(t):
    rows = ops.volume_contract(
        t.deliveries, ["dag_id"], "ts", "event_id", n=3, tolerance=15000.0, least=1, accepted="rows BETWEEN 1 AND 25000"
    )
    return rows.select("event_id", "verdict")


@query(
    "dbt_run_summary",
    """SELECT project, count(*) AS n_results, count(*) FILTER (WHERE status = 'success') AS n_success,
         count(*) FILTER (WHERE status = 'error') AS n_error, cast(sum(cast(value AS decimal(20,6))) AS double) AS execute_seconds,
         max(value) AS longest_seconds, string_agg(DISTINCT code, ',' ORDER BY code) AS error_codes
       FROM {results} GROUP BY project""",
)
def _(t):
    timing = F.array(
        F.struct(F.lit("compile").alias("name"), F.lit(0.5).alias("duration")),
        F.struct(F.lit("execute").alias("name"), F.col("value").alias("duration")),
    )
    return ops.dbt_run_summary(t.results.withColumn("timing", timing), ["project"])


@query(
    "failing_file",
    r"""SELECT run_id, nullif(regexp_extract(message, '\((models/[^)]+\.sql)\)', 1), '') AS failing_file FROM {results}""",
)
def _(t):
    return ops.failing_file(t.results).select("run_id", "failing_file")


@query(
    "last_touch",
    """SELECT o.event_id AS order_id, s.event_id AS session_id, s.event_type AS channel
       FROM (SELECT * FROM {events} WHERE event_type = 'purchase') o
       ASOF JOIN (SELECT * FROM {events} WHERE event_type IN ('click', 'view')) s ON o.user_id = s.user_id AND o.ts >= s.ts
       WHERE s.ts >= o.ts - INTERVAL 30 DAY""",
)
def _(t):
    orders = t.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("order_id"), "user_id", F.col("ts").alias("order_ts")
    )
    sessions = t.events.where("event_type IN ('click', 'view')").select(
        "user_id", F.col("ts").alias("session_ts"), F.col("event_id").alias("session_id"), F.col("event_type").alias("channel")
    )
    return workloads.last_touch(orders, sessions).select("order_id", "session_id", "channel")


@query(
    "churn_daily",
    """SELECT o_orderkey AS subscription_id, c_custkey AS customer_id, c_mktsegment AS segment, o_totalprice AS price,
         strftime(o_orderdate, '%Y-%m-%d') AS churn_date
       FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
)
def _(t):
    subscriptions = t.orders.select(
        F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("canceled_at"),
        F.when(F.col("o_orderstatus") == "F", "canceled").otherwise("active").alias("status"),
    )
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    rows = workloads.churn_daily(subscriptions, customers)
    return rows.select(
        "subscription_id", "customer_id", "segment", "price", F.col("churn_date").cast("string").alias("churn_date")
    )


@query(
    "customer_spend",
    """SELECT c_custkey AS customer_id, c_name AS name, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total_spend
       FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY ALL""",
)
def _(t):
    sales = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    rows = workloads.customer_spend(customers, sales)
    return rows.withColumn("total_spend", F.col("total_spend").cast("double"))


@query(
    "daily_revenue",
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS order_date, count(DISTINCT l_orderkey) AS total_orders,
         cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS gross_revenue
       FROM {lineitem} GROUP BY 1""",
)
def _(t):
    sales = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("order_ts"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    return workloads.daily_revenue(sales).select(
        F.col("order_date").cast("string").alias("order_date"), "total_orders",
        F.col("gross_revenue").cast("double").alias("gross_revenue"),
    )


@query(
    "take_rate",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_tax, 0), 4) AS take_rate FROM {lineitem}""",
)
def _(t):
    rows = workloads.safe_ratio(t.lineitem, "l_extendedprice", "l_tax", "take_rate")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("take_rate", 4).alias("take_rate"))


@query(
    "monthly_cohorts",
    """WITH m AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS month FROM {orders}),
         c AS (SELECT u, month, min(month) OVER (PARTITION BY u) AS cohort FROM m)
       SELECT strftime(cohort, '%Y-%m-%d') AS cohort, cast(date_diff('month', cohort, month) AS int) AS period, count(*) AS users
       FROM c GROUP BY 1, 2""",
)
def _(t):
    activity = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    rows = workloads.monthly_cohorts(activity)
    return rows.withColumn("cohort", F.col("cohort").cast("string"))
