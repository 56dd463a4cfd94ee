"""Queries over source files and model lineage."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import functions as F

from faultline.operators import lineage, ownership, patches, triage
from faultline.plans import alerts, derived
from faultline.plans.registry import query
from faultline.plans.triage import routed

# Lines of a source file, their guarded form, and the divisions on them as (numerator, denominator). ``#`` stands for the
# number of the file, ``%`` for a remainder of it, ``@`` for the text of the document.
NOTE = patches.GUARD_NOTE
FILE_LINES = (
    (
        "select net_# / gross_% as rate, 'data/raw' as p,",
        f"select net_# / NULLIF(gross_%, 0) as rate, 'data/raw' as p,{NOTE}",
        [("net_#", "gross_%")],
    ),
    ("  -- a / b only a remark", None, []),
    (
        "  cents / 100.0 as usd, t.paid/t.due as share,   ",
        f"  cents / 100.0 as usd, t.paid / NULLIF(t.due, 0) as share,{NOTE}",
        [("t.paid", "t.due")],
    ),
    ("  total / count(x) as mean, x / NULLIF(y, 0) as safe, 'http://host/path' as url", None, []),
    (
        "  a/b/c as chain, (a + b)/c as part, -- d / e",
        f"  a / NULLIF(b, 0) / NULLIF(c, 0) as chain, (a + b) / NULLIF(c, 0) as part, -- d / e{NOTE}",
        [("a", "b"), ("b", "c"), ("(...)", "c")],
    ),
    (
        "  p / (q - f(r)) as gap, p / (2 * 3) as sixth",
        f"  p / NULLIF((q - f(r)), 0) as gap, p / (2 * 3) as sixth{NOTE}",
        [("p", "(...)")],
    ),
    (
        "  'it''s / not' || \"m / n\".o / \"s\"",
        f"  'it''s / not' || \"m / n\".o / NULLIF(\"s\", 0){NOTE}",
        [('"m / n".o', '"s"')],
    ),
    ("  , {{ ref('x/y') }} as z, k / {{ w }} as late, g / h[1] as one", None, []),
    ("  c.ledger_party_id, my_ledger_party_id_x /* e / f", None, []),
    ("  @ g / h */, i / j as after", f"  @ g / h */, i / NULLIF(j, 0) as after{NOTE}", [("i", "j")]),
    ('resources = dict("memory": "2048Mi", "cpu": "1000m")', None, []),
)
COLUMNS = {"#": "cast(doc_id AS string)", "%": "cast(doc_id % 7 AS string)", "@": "text"}


def _literal(line: str, marks: str = "#%@") -> str:
    """A line as an SQL expression."""
    pieces = []
    for piece in re.split(f"([{marks}])", line):
        quoted = "'" + piece.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"
        pieces.append(COLUMNS[piece] if piece and piece in marks else quoted)
    return " || ".join(pieces)


def _file(lines) -> str:
    """Lines and, in every second file, one more, as an SQL expression."""
    body = " || ".join(f"{_literal(line)} || chr(10)" for line in lines)
    return body + " || CASE WHEN doc_id % 2 = 0 THEN 'limits: ''memory'': ''8Gi''' || chr(10) ELSE '' END"


derived.DERIVED["repo_files"] = f"""
SELECT doc_id, text, source AS repo, 'queries/q_' || cast(doc_id AS string) || '.sql' AS file_path,
  {_file(line for line, _, _ in FILE_LINES)} AS content
FROM {{documents}}
"""

# Content always ends with a line end, so lines are the parts before the last one.
LINES = "string_split(substr(content, 1, length(content) - 1), chr(10))"
IS_CODE = "contains(x, '/') AND NOT starts_with(regexp_replace(x, '^\\s+', ''), '--')"


def edited(condition: str, edit: str, note: str) -> str:
    return f"""SELECT doc_id, content, array_to_string(list_transform({LINES}, lambda x: CASE WHEN {condition} AND {edit} <> x
      THEN regexp_replace({edit}, '\\s+$', '') || '{note}' ELSE x END), chr(10)) || chr(10) AS patched FROM {{repo_files}}"""


NULLIF_ANY = r"regexp_replace(x, '(\w+)\s*/\s*(\w+)', '\1 / NULLIF(\2, 0)', 'g')"
MEMORY = r"""regexp_replace(x, '(''memory'':\s*''[0-9]+[A-Za-z]+''|"memory":\s*"[0-9]+[A-Za-z]+")', '''memory'': ''4096Mi''', 'g')"""
IS_MEMORY = (
    "(contains(x, 'limits') OR contains(x, 'resources') OR contains(x, 'memory')) AND (contains(x, 'Mi') OR contains(x, 'Gi'))"
)

derived.DERIVED["guarded_any"] = edited(IS_CODE, NULLIF_ANY, patches.GUARD_NOTE)
# The guarded file is put together from the lines above; no pattern takes part.
derived.DERIVED["guarded_named"] = f"""
SELECT doc_id, content, {_file(guarded or line for line, guarded, _ in FILE_LINES)} AS patched FROM {{repo_files}}
"""
derived.DERIVED["resized"] = edited(IS_MEMORY, MEMORY, patches.MEMORY_NOTE)


@query("patch_nullif", "SELECT doc_id, patched FROM {guarded_any}")
def _(t):
    return patches.patch_zero_division(t.repo_files, literal_too=True).select("doc_id", "patched")


@query("patch_nullif_named", "SELECT doc_id, patched FROM {guarded_named}")
def _(t):
    return patches.patch_zero_division(t.repo_files).select("doc_id", "patched")


@query(
    "patch_rename",
    r"""SELECT doc_id, regexp_replace(content, '\bledger_party_id\b', 'party_id', 'g') AS whole_words,
         replace(content, 'ledger_party_id', 'party_id') AS everywhere FROM {repo_files}""",
)
def _(t):
    words = patches.patch_column_rename(t.repo_files, "ledger_party_id", "party_id")
    both = patches.patch_column_rename(
        words.withColumnRenamed("patched", "whole_words"), "ledger_party_id", "party_id", whole_words=False
    )
    return both.select("doc_id", "whole_words", F.col("patched").alias("everywhere"))


@query("patch_memory", "SELECT doc_id, patched FROM {resized}")
def _(t):
    return patches.patch_memory_limit(t.repo_files).select("doc_id", "patched")


# The whole diff from numbered lines: changes with up to six lines between them share a hunk, and
# within a hunk lines that change together list their old forms first.
DIFF = """
  WITH {source},
    l AS (SELECT id, unnest(string_split(substr(content, 1, length(content) - 1), chr(10))) AS o,
        unnest(string_split(substr(patched, 1, length(patched) - 1), chr(10))) AS n,
        unnest(range(len(string_split(substr(content, 1, length(content) - 1), chr(10))))) AS i FROM src WHERE content <> patched),
    c AS (SELECT id, i, i - lag(i) OVER (PARTITION BY id ORDER BY i) > 7 AS far FROM l WHERE o <> n),
    h AS (SELECT id, g, greatest(min(i) - 3, 0) AS lo, max(i) + 3 AS hi FROM (
        SELECT id, i, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM c) x GROUP BY id, g),
    b AS (SELECT l.id, h.g, l.i, l.o, l.n, l.o <> l.n AS d, l.i - row_number() OVER (PARTITION BY l.id, h.g, l.o <> l.n ORDER BY l.i) AS island
        FROM l JOIN h ON l.id = h.id AND l.i BETWEEN h.lo AND h.hi),
    s AS (SELECT id, g, CASE WHEN d THEN min(i) OVER (PARTITION BY id, g, d, island) ELSE i END AS place, sign, i, CASE WHEN d THEN sign ELSE ' ' END
          || CASE WHEN sign = '+' THEN n ELSE o END || chr(10) AS line
        FROM b, (SELECT unnest(['-', '+']) AS sign) z WHERE d OR sign = '-'),
    t AS (SELECT id, g, '@@ -' || span || ' +' || span || ' @@' || chr(10) || body AS hunk FROM (
        SELECT s.id, s.g, (min(s.i) + 1) || CASE WHEN max(s.i) = min(s.i) THEN '' ELSE ',' || (max(s.i) - min(s.i) + 1) END AS span,
          string_agg(line, '' ORDER BY place, CASE sign WHEN '-' THEN 0 ELSE 1 END, s.i) AS body FROM s GROUP BY s.id, s.g) y)
"""


@query(
    "patch_diffs",
    DIFF.replace(
        "{source}",
        "src AS (SELECT doc_id AS id, content, patched, 'queries/q_' || cast(doc_id AS string) || '.sql' AS path FROM {guarded_named})",
    )
    + """SELECT id AS doc_id, '--- a/' || any_value(path) || chr(10) || '+++ b/' || any_value(path) || chr(10) || string_agg(hunk, '' ORDER BY g) AS unified_diff
      FROM t JOIN (SELECT id, path FROM src) p USING (id) GROUP BY id""",
)
def _(t):
    diffs = patches.patch_diffs(patches.patch_zero_division(t.repo_files))
    return diffs.select("doc_id", "unified_diff")


# A file of which lines are deleted, inserted, changed and moved; the text of the document follows, unchanged.
BEFORE = [f"line {k} of #" for k in range(1, 31)]
AFTER = ["first of #", *BEFORE[:4], "new a", "new b #", *BEFORE[4:9], *BEFORE[11:20], "line 21 changed", *BEFORE[21:24], *BEFORE[25:27], BEFORE[24], *BEFORE[27:]]
EXPECTED = difflib.unified_diff(BEFORE, AFTER, "a/q.sql", "b/q.sql", lineterm="")

derived.DERIVED["file_versions"] = f"""
SELECT doc_id, 'q.sql' AS file_path, {" || ".join(f"{_literal(x)} || chr(10)" for x in BEFORE)} || text AS content,
  {" || ".join(f"{_literal(x)} || chr(10)" for x in AFTER)} || text AS patched
FROM {{documents}}
"""


# The expected text comes from another implementation, run on the lines above.
@query(
    "file_diffs",
    "SELECT doc_id, " + " || ".join(f"{_literal(x, '#')} || chr(10)" for x in EXPECTED) + " AS unified_diff FROM {file_versions} WHERE content IS NOT NULL",
)
def _(t):
    return patches.file_diffs(t.file_versions).select("doc_id", "unified_diff")


@query(
    "patch_affected_files",
    """SELECT g.doc_id, o.n_incidents, g.patched <> g.content AS changed
       FROM (SELECT target_file_path, count(*) AS n_incidents FROM {owners} WHERE repo_name = 'analytics-dbt' GROUP BY 1) o
       JOIN {guarded_named} g ON o.target_file_path = 'models/m_' || cast(g.doc_id AS string) || '.sql'""",
)
def _(t):
    owners = ownership.resolve_owner(alerts.owned(t), t.manifest_nodes, alerts.catalog(t))
    path = F.concat(F.lit("models/m_"), F.col("doc_id").cast("string"), F.lit(".sql"))
    files = t.repo_files.withColumns({"repo": F.lit("analytics-dbt"), "file_path": path})
    rows = patches.patch_zero_division(patches.affected_files(owners, files))
    return rows.select("doc_id", "n_incidents", (F.col("content") != F.col("patched")).alias("changed"))


derived.DERIVED["patch_requests"] = """
SELECT run_id, task_id, CASE event_id % 5 WHEN 0 THEN 'dbt-core' WHEN 1 THEN 'custom-sql' WHEN 2 THEN 'airflow-native' WHEN 3 THEN 'terraform' END AS framework,
  'models/marts/m_' || cast(user_id AS string) || '.sql' AS file_path, 'ledger_party_id' AS old_column,
  'account_' || cast(user_id % 3 AS string) AS new_column, '4096Mi' AS new_memory
FROM {task_runs} WHERE event_type = 'error'
"""


@query(
    "patch_plan",
    """SELECT run_id, framework, CASE WHEN framework IN ('dbt-core', 'custom-sql', 'airflow-native') THEN 'SUCCESS' ELSE 'FAILED' END AS status,
         CASE framework WHEN 'dbt-core' THEN 'fix/dbt-rename-' || new_column WHEN 'custom-sql' THEN 'fix/sql-nullif-guard'
           WHEN 'airflow-native' THEN 'infra/raise-memory-' || task_id END AS branch_name,
         CASE framework WHEN 'dbt-core' THEN 'fix(dbt): use ' || new_column || ' for ledger_party_id in ' || split_part(file_path, '/', -1)
           WHEN 'custom-sql' THEN 'fix(sql): guard divisors in ' || split_part(file_path, '/', -1)
           WHEN 'airflow-native' THEN 'infra(dag): 4096Mi memory for task ' || task_id END AS title,
         CASE WHEN framework = 'terraform' THEN 'no patcher for framework terraform' WHEN framework IS NULL THEN 'no patcher for framework (none)' END AS error
       FROM {patch_requests}""",
)
def _(t):
    return patches.patch_plan(t.patch_requests).select("run_id", "framework", "status", "branch_name", "title", "error")


# Files of the owners' repositories: the source files of the corpus under the paths that owners point at.
derived.DERIVED["owned_files"] = """
SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'analytics-dbt' ELSE 'financial-core-sql' END AS repo,
  'models/m_' || cast(doc_id AS string) || '.sql' AS file_path, content FROM {repo_files}
"""

derived.DERIVED["drifts"] = """
SELECT run_id, cluster, dag_id, task_id, attempt, event_id, event_id % 400 AS file_no,
  CASE event_id % 7 WHEN 0 THEN 'custom-sql' WHEN 1 THEN 'airflow-native' WHEN 2 THEN 'terraform' WHEN 3 THEN 'dbt-core' END AS framework
FROM {failed_runs}
"""


@query(
    "incident_patches",
    DIFF.replace(
        "{source}",
        r"""req AS (SELECT d.*, r.failure_category, r.route, CASE WHEN d.event_id % 3 = 0 THEN 'financial-core-sql' ELSE 'analytics-dbt' END AS repo_name,
              'models/m_' || file_no || '.sql' AS file_path,
              CASE WHEN framework = 'dbt-core' THEN 'rename' WHEN framework = 'custom-sql' THEN 'guard' WHEN framework = 'airflow-native' THEN 'memory'
                WHEN framework IS NULL THEN CASE failure_category WHEN 'STRUCTURAL_SCHEMA_DRIFT' THEN 'rename'
                  WHEN 'STRUCTURAL_DIVISION_BY_ZERO' THEN 'guard' WHEN 'TRANSIENT_OOM' THEN 'memory' END END AS kind
              FROM {drifts} d JOIN {routed} r ON d.run_id = r.run_id),
            jobs AS (SELECT DISTINCT repo_name, file_path, kind FROM req WHERE kind IS NOT NULL),
            src AS (SELECT repo_name || '|' || j.file_path || '|' || kind AS id, j.file_path AS path, f.content,
                CASE kind WHEN 'rename' THEN regexp_replace(f.content, '\bledger_party_id\b', 'net$_id', 'g')
                  WHEN 'guard' THEN g.patched ELSE m.patched END AS patched
              FROM jobs j JOIN {owned_files} f ON f.repo = j.repo_name AND f.file_path = j.file_path
              JOIN {guarded_named} g ON g.doc_id = f.doc_id JOIN {resized} m ON m.doc_id = f.doc_id)""",
    )
    + """, diffs AS (SELECT id, '--- a/' || any_value(path) || chr(10) || '+++ b/' || any_value(path) || chr(10) || string_agg(hunk, '' ORDER BY g) AS code_diff
            FROM t JOIN (SELECT id, path FROM src) p USING (id) GROUP BY id)
       SELECT run_id, repo_name, CASE WHEN kind IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status, code_diff,
         CASE WHEN code_diff IS NOT NULL THEN 'https://git.example.com/' || repo_name || '/compare/'
           || CASE kind WHEN 'rename' THEN 'fix/dbt-rename-net$_id' WHEN 'guard' THEN 'fix/sql-nullif-guard' ELSE 'infra/raise-memory-' || task_id END END AS pr_url,
         CASE WHEN route = 'approval' THEN 'apr-' || sha256(cluster || '/' || dag_id || '/' || task_id || '/' || run_id || '/' || attempt) END AS approval_id
       FROM req LEFT JOIN diffs ON id = repo_name || '|' || file_path || '|' || kind""",
)
def _(t):
    repo = F.when(F.col("event_id") % 3 == 0, "financial-core-sql").otherwise("analytics-dbt")
    decided = routed(t)
    requests = t.drifts.join(decided.select("run_id", "failure_category"), "run_id").select(
        "run_id", "task_id", "framework", "failure_category", repo.alias("repo_name"),
        F.concat(F.lit("https://git.example.com/"), repo, F.lit(".git")).alias("repo_url"),
        F.concat(F.lit("models/m_"), F.col("file_no").cast("string"), F.lit(".sql")).alias("target_file_path"),
        F.lit("ledger_party_id").alias("old_column"), F.lit("net$_id").alias("new_column"),
    )
    plan = patches.incident_patches(requests, t.owned_files.select("repo", "file_path", "content"))
    asked = triage.approval_requests(decided.join(plan.select("run_id", "code_diff", "pr_url"), "run_id", "left"))
    return plan.drop("code_diff", "pr_url").join(
        plan.select("run_id", "code_diff", "pr_url").join(asked.select("run_id", "approval_id"), "run_id", "left"), "run_id"
    ).select("run_id", "repo_name", "status", "code_diff", "pr_url", "approval_id")


def _division_rows() -> str:
    """The divisions of the lines above, one SELECT each; lines behind the text of the document move down."""
    found, moved = [], False
    for number, (line, _, divisions) in enumerate(FILE_LINES, 1):
        moved = moved or "@" in line
        more = " + length(text) - length(replace(text, chr(10), ''))" if moved else ""
        for numerator, denominator in divisions:
            found.append(
                f"SELECT file_path, cast({number}{more} AS int) AS line_no, {_literal(numerator)} AS numerator, "
                f"{_literal(denominator)} AS denominator FROM {{repo_files}} WHERE content IS NOT NULL"
            )
    return " UNION ALL ".join(found)


@query("division_scan", _division_rows())
def _(t):
    return patches.division_scan(t.repo_files).select("file_path", "line_no", "numerator", "denominator")


derived.DERIVED["model_edges"] = """
SELECT c_custkey AS node, IDIV(c_custkey, 2) AS parent FROM {customer} WHERE c_custkey > 0
UNION
SELECT c_custkey, IDIV(c_custkey, 3) FROM {customer} WHERE c_custkey > 0 AND c_custkey % 5 = 0
"""

CLOSURE = """WITH RECURSIVE walk AS (
    SELECT node, parent AS ancestor, 1 AS depth FROM {model_edges}
    UNION SELECT w.node, e.parent, w.depth + 1 FROM walk w JOIN {model_edges} e ON w.ancestor = e.node),
  pairs AS (SELECT node, ancestor, cast(min(depth) AS int) AS depth FROM walk GROUP BY ALL) """


@query("lineage_closure", CLOSURE + "SELECT * FROM pairs")
def _(t):
    return lineage.lineage_closure(t.model_edges)


@query(
    "blast_radius",
    CLOSURE + """SELECT ancestor AS node, count(*) AS n_downstream, max(depth) AS reach
      FROM pairs WHERE ancestor % 7 = 3 GROUP BY ancestor""",
)
def _(t):
    broken = t.customer.where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("node"))
    return lineage.blast_radius(t.model_edges, broken)


# The same three columns in seven spellings: a CTE, upper case with AS, a direct reference with a remark, a CTE under its own
# name after a comment, unqualified names, a CTE over a CTE, and two relations of which one holds a name. One model in eleven
# declares nothing and passes on what it reads.
derived.DERIVED["model_nodes"] = """
SELECT 'm_' || cast(c_custkey AS string) AS name, CASE WHEN c_custkey % 11 = 1 THEN 'select * from {{{{ ref(''' || up || ''') }}}}'
  ELSE CASE c_custkey % 7
  WHEN 0 THEN 'with up as (select * from {{{{ ref(''' || up || ''') }}}})' || chr(10) || 'select u.id, u.ledger_party_id,'
    || chr(10) || '  u.balance_' || no || chr(10) || 'from up u' || chr(10) || 'where u.id > 0'
  WHEN 1 THEN 'WITH UP AS (' || chr(10) || '  SELECT * FROM {{{{ ref(''' || up || ''') }}}}' || chr(10) || ')' || chr(10)
    || 'SELECT U.id, U.ledger_party_id, U.balance_' || no || chr(10) || 'FROM up AS U'
  WHEN 2 THEN 'select u.id, u.ledger_party_id, u.balance_' || no || ' -- not u.remark, from old u' || chr(10)
    || 'from {{{{ ref("' || up || '") }}}} as u'
  WHEN 3 THEN '/* from {{{{ ref(''m_0'') }}}} up, up.gone */' || chr(10) || 'with up as (select * from {{{{ ref(''' || up || ''') }}}})' || chr(10)
    || 'select up.id, up.ledger_party_id, up.balance_' || no || ' from up'
  WHEN 4 THEN 'select id, upper(ledger_party_id) as account, ''gone.x'' as note,' || chr(10) || '  sum(balance_' || no
    || ') over (partition by id order by id) as running, running * 2 as twice' || chr(10) || 'from {{{{ ref(''' || up || ''') }}}} where id::int > 0 group by account'
  WHEN 5 THEN 'with a as (select * from {{{{ ref(''' || up || ''') }}}}), b as (select * from a where id > 0)' || chr(10)
    || 'select b.id, ledger_party_id from b where exists (select 1 from other o where o.x = b.balance_' || no || ')'
  ELSE 'with a as (select * from {{{{ ref(''' || up || ''') }}}}), k as (select 1 as flag, id as no from {{{{ ref(''' || up || ''') }}}})' || chr(10)
    || 'select y.ledger_party_id, flag from (select ledger_party_id, balance_' || no || ' as b from a) y join k on k.no = y.b' END END AS raw_code,
  up, no, c_custkey % 11 = 1 AS passes,
  CASE WHEN c_custkey % 11 = 1 THEN NULL WHEN c_custkey % 4 = 0 THEN 'id,party_id,balance_0,balance_1'
    ELSE 'id,ledger_party_id,balance_0,balance_1,balance_2' END AS declared
FROM (SELECT c_custkey, 'm_' || cast(IDIV(c_custkey, 2) AS string) AS up, cast(c_custkey % 3 AS string) AS no FROM {customer}) c
"""


@query(
    "contract_breaks",
    r"""WITH used AS (SELECT m.name AS node, CASE WHEN p.passes THEN p.up ELSE m.up END AS upstream,
           unnest(['id', 'ledger_party_id', 'balance_' || m.no]) AS col
         FROM {model_nodes} m LEFT JOIN {model_nodes} p ON p.name = m.up WHERE NOT m.passes),
         decl AS (SELECT name AS upstream, string_split(declared, ',') AS cols FROM {model_nodes} WHERE declared IS NOT NULL),
         gone AS (SELECT node, u.upstream, col, cols FROM used u JOIN decl d ON u.upstream = d.upstream WHERE NOT list_contains(cols, col)),
         scored AS (SELECT node, upstream, col, c, levenshtein(c, col) AS d,
           (node, upstream, c) IN (SELECT (node, upstream, col) FROM used) AS known FROM (SELECT *, unnest(cols) AS c FROM gone) g)
       SELECT node, upstream, col AS "column", arg_min(c, struct_pack(known := known, d := d, c := c)) AS rename_to FROM scored GROUP BY ALL""",
)
def _(t):
    nodes = t.model_nodes.select("name", "raw_code", F.split("declared", ",").alias("columns"))
    return lineage.contract_breaks(nodes)
