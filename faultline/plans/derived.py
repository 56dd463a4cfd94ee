"""Relations derived from the analytics tables, in SQL both engines understand.

``events`` stands in for a scheduler's history: each event is one task attempt,
``error`` events are the failed ones. Nothing is sampled; every derived relation
covers its whole source table. Sources appear as ``{name}`` and are bound to
DataFrames in Spark and to views in the SQL check. ``US(x)`` (microseconds since
1970) and ``IDIV(a, b)`` (whole-number division) are the only dialect gaps.
"""

from __future__ import annotations

import re

DERIVED: dict[str, str] = {}

DERIVED["runs_base"] = """
SELECT event_id, user_id, ts, value, event_type, props,
  CASE user_id % 3 WHEN 0 THEN 'us-prod-1' WHEN 1 THEN 'eu-analytics-1' ELSE 'apac-data-1' END AS cluster,
  CASE WHEN user_id % 12 < 4 THEN 'dbt_marts_' ELSE 'dag_' END || cast(user_id % 12 AS string) AS dag_id,
  'task_' || cast(user_id % 4 AS string) AS task_id,
  'run_' || cast(event_id AS string) AS run_id,
  replace(substr(cast(ts AS string), 1, 13), ' ', 'T') || ':00:00' AS execution_date,
  replace(substr(cast(ts AS string), 1, 19), ' ', 'T') AS stamp,
  cast(event_id % 4 + 1 AS int) AS attempt,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state,
  (event_id * 7 + user_id) % 20 AS msg_no,
  cast(event_id % 60 + 1 AS int) AS models_done,
  cast(1000 + (event_id * 13) % 1100 AS int) AS rss_mib
FROM {events}
"""

# One message per classification rule, two texts with two signatures each, digits
# that merely contain a status code, terms of one rule on two lines, no signature.
DERIVED["task_runs"] = """
SELECT event_id, user_id, ts, value, event_type, cluster, dag_id, task_id, run_id, execution_date,
  attempt, state,
  CASE event_id % 6 WHEN 0 THEN 'DbtRunOperator' WHEN 1 THEN 'KubernetesPodOperator'
    WHEN 2 THEN 'CustomSQLBatchOperator' WHEN 3 THEN 'PostgresOperator'
    WHEN 4 THEN 'KubernetesPodOperator' ELSE 'PythonOperator' END AS operator,
  CASE event_id % 6 WHEN 0 THEN 'dbt run --select marts' WHEN 1 THEN 'merge into target using source'
    WHEN 2 THEN 'insert into ledger values (1, 100)'
    WHEN 3 THEN 'INSERT INTO ledger VALUES (1) ON CONFLICT DO NOTHING'
    WHEN 4 THEN 'truncate table staging' ELSE 'SELECT 1' END AS code,
  cast(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 4096 WHEN 3 THEN 16384
    ELSE 32768 END AS int) AS requested_memory,
  '[' || stamp || '.000+0000] {{taskinstance.py:1165}} INFO - Starting task: ' || dag_id || '.' || task_id || chr(10)
  || '[' || stamp || '.250+0000] {{pod_manager.py:315}} INFO - Model ' || cast(models_done AS string)
  || '/60 marts.m completed in ' || cast(models_done % 7 AS string) || '.25s (Current RSS: '
  || cast(rss_mib AS string) || 'MiB)' || chr(10) || chr(10)
  || CASE WHEN event_type <> 'error' THEN
       '[' || stamp || '.500+0000] {{pod_manager.py:315}} INFO - Finished running models. Peak container memory RSS: '
       || cast(rss_mib + 40 AS string) || 'MiB (utilization: ' || cast(rss_mib % 100 AS string) || '.5% of 2048Mi limit).' || chr(10)
       || '[' || stamp || '.900+0000] {{taskinstance.py:1406}} INFO - Marking task as SUCCESS. exit code: 0'
     ELSE
       '[' || stamp || '.500+0000] {{operator.py:' || cast(msg_no + 40 AS string) || '}} '
       || CASE WHEN msg_no % 3 = 0 THEN 'CRITICAL' ELSE 'ERROR' END || ' - '
       || CASE msg_no
          WHEN 0 THEN 'worker process gone: OOMKilled, exit code 137'
          WHEN 1 THEN 'worker node reclaimed by its provider, exit code 143 (TerminatedByPreemption)'
          WHEN 2 THEN 'spill failed, No space left on device; usage 53.5Gi exceeded limit 48Gi'
          WHEN 3 THEN 'query stopped by Statement Timeout (900000ms exceeded)'
          WHEN 4 THEN 'Database connection pool exhausted (max_connections=350); 118 worker tasks connected'
          WHEN 5 THEN 'store refused the signature: RequestTimeTooSkewed, clock drifted by 733 seconds'
          WHEN 6 THEN 'margin step failed with division by zero'
          WHEN 7 THEN 'feed check ZERO_ROWS_DELIVERED: received 0 rows, baseline: 91,500 +/- 2,750'
          WHEN 8 THEN 'transaction rolled back, DeadlockDetected' || chr(10) || 'Process ' || cast(1000 + user_id % 40 AS string)
               || ' waits for ShareLock; blocked by process ' || cast(1000 + event_id % 40 AS string)
          WHEN 9 THEN 'partner service said Too Many Requests, Rate Limit reached, Retry-After: 45'
          WHEN 10 THEN 'key test of invoices: 17 duplicate keys found'
          WHEN 11 THEN 'column "ledger_code" does not exist in relation "stg_invoices"'
          WHEN 12 THEN 'model could not be built: syntax error at or near WHERE'
          WHEN 13 THEN 'Sensor has timed out while the hour was not there'
          WHEN 14 THEN 'gateway gave 503 Service Unavailable, later Connection reset by peer'
          WHEN 15 THEN 'out of memory after lock wait timeout'
          WHEN 16 THEN 'division by zero while the statement timeout was pending'
          WHEN 17 THEN 'booked 64293 units before the job ended'
          WHEN 18 THEN 'bad column reference' || chr(10) || '  hint: relation was not found'
          ELSE 'worker stopped for an unspecified cause' END || chr(10)
       || 'Traceback (most recent call last):' || chr(10) || '  File "job.py", line 12   ' || chr(10)
       || '[' || stamp || '.900+0000] {{taskinstance.py:1406}} INFO - Marking task as FAILED. exit code: 1' END AS log_text
FROM {runs_base}
"""

DERIVED["failed_runs"] = "SELECT * FROM {task_runs} WHERE event_type = 'error'"


def names_in(text: str) -> list[str]:
    """Relations a template refers to, in order of first use."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def _fill(text: str, names: dict[str, str]) -> str:
    for name, replacement in names.items():
        text = re.sub(r"(?<!\{)\{" + name + r"\}(?!\})", replacement, text)
    return text


def _dialect(text: str, us: str, idiv: str) -> str:
    text = re.sub(r"\bUS\(([^()]+)\)", us, text)
    return re.sub(r"\bIDIV\(([^(),]+), ([^(),]+)\)", idiv, text)


def spark_text(name: str) -> str:
    """Derived relation as text for ``spark.sql`` with DataFrame arguments."""
    return _dialect(DERIVED[name], r"unix_micros(cast(\1 AS timestamp))", r"(\1 div \2)")


def check_text(body: str) -> str:
    """A whole statement for the SQL check: derived relations become CTEs."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for name in names_in(text):
            if name in DERIVED and name not in ctes:
                need(DERIVED[name])
                ctes[name] = DERIVED[name]

    need(body)

    def plain(text: str) -> str:
        text = _fill(text, {n: n for n in names_in(text)})
        text = _dialect(text, r"epoch_us(\1)", r"(\1 // \2)")
        return text.replace("{{", "{").replace("}}", "}")

    parts = [f"{name} AS ({plain(text).strip()})" for name, text in ctes.items()]
    body = plain(body).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[14:].lstrip()
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
