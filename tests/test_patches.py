"""Patches on single lines and whole files."""

import re

import pytest

from faultline.functions import diffs
from faultline.operators import lineage, patches


def run(spark, content, patch, **options):
    files = spark.createDataFrame([("r", "q/f.sql", content)], "repo string, file_path string, content string")
    return patch(files, **options)


def patched(spark, content, patch, **options):
    return run(spark, content, patch, **options).first().patched


GUARD = patches.GUARD_NOTE + "\n"


@pytest.mark.parametrize(
    "line, named, any_word",
    [
        ("net / gross\n", "net / NULLIF(gross, 0)" + GUARD, "net / NULLIF(gross, 0)" + GUARD),
        ("net/gross as r,  \n", "net / NULLIF(gross, 0) as r," + GUARD, "net / NULLIF(gross, 0) as r," + GUARD),
        ("x / 100.0\n", None, "x / NULLIF(100, 0).0" + GUARD),
        ("a / t.b\n", "a / NULLIF(t.b, 0)" + GUARD, "a / NULLIF(t, 0).b" + GUARD),
        ("a / f(x)\n", None, "a / NULLIF(f, 0)(x)" + GUARD),
        ("a / NULLIF(b, 0)\n", None, "a / NULLIF(NULLIF, 0)(b, 0)" + GUARD),
        ("a/b/c\n", "a / NULLIF(b, 0) / NULLIF(c, 0)" + GUARD, "a / NULLIF(b, 0)/c" + GUARD),
        ("(a + b)/c\n", "(a + b) / NULLIF(c, 0)" + GUARD, None),
        ("  -- a / b\n", None, None),
        ("no slash\n", None, None),
        ("last / line", "last / NULLIF(line, 0)" + GUARD, "last / NULLIF(line, 0)" + GUARD),
        ("", None, None),
    ],
)
def test_zero_division(spark, line, named, any_word):
    assert patched(spark, line, patches.patch_zero_division) == (named or line)
    assert patched(spark, line, patches.patch_zero_division, literal_too=True) == (any_word or line)


def test_guard_is_idempotent(spark):
    content = "select a / b, c/d.e\n-- x / y\nfrom t where z / f(x) > 1 / 2\n"
    once = patched(spark, content, patches.patch_zero_division)
    assert once != content
    assert patched(spark, once, patches.patch_zero_division) == once


def test_rename(spark):
    sql = "\nSELECT\n    c.ledger_party_id,\n    old_ledger_party_id\nFROM s ON c.ledger_party_id = 1;\n"
    words = patched(spark, sql, patches.patch_column_rename, old="ledger_party_id", new="party_id")
    assert words.count("c.party_id") == 2 and "old_ledger_party_id" in words
    anywhere = patched(
        spark, sql, patches.patch_column_rename, old="ledger_party_id", new="party_id", whole_words=False
    )
    assert "ledger_party_id" not in anywhere
    diff = patches.patch_diffs(
        run(spark, sql, patches.patch_column_rename, old="ledger_party_id", new="party_id")
    ).first().unified_diff
    assert diff.startswith("--- a/q/f.sql\n+++ b/q/f.sql\n")
    assert "\n+    c.party_id,\n" in diff


def test_memory(spark):
    code = "limits={'cpu': '1', 'memory': '2048Mi'}\nresources = {\"memory\":  \"8Gi\"}\nmemory = 5\n'memory': '64Ki'\n"
    out = patched(spark, code, patches.patch_memory_limit, new_memory="6144Mi").split("\n")
    assert out[0] == "limits={'cpu': '1', 'memory': '6144Mi'}" + patches.MEMORY_NOTE
    assert out[1] == "resources = {'memory': '6144Mi'}" + patches.MEMORY_NOTE
    assert out[2:] == ["memory = 5", "'memory': '64Ki'", ""]


def test_unchanged_files_have_no_diff(spark):
    assert patches.patch_diffs(run(spark, "select 1\n", patches.patch_zero_division)).count() == 0


def test_division_scan(spark):
    rows = run(
        spark, "select a / b,\n -- c / d\n e/f.g + h / 2 + i / j(k)\n x / NULLIF(y, 0)\n", patches.division_scan
    ).collect()
    assert {(r.line_no, r.numerator, r.denominator) for r in rows} == {(1, "a", "b"), (3, "e", "f.g")}

TRICKY = """select a / b, 'data/raw', 'http://h/p', x/y/z as c,   -- e / f
 /* c / d
 and */ p / (q - r) as k, (a + b)/c, a / 100.0, n / f(x), n/NULLIF(m, 0), 'multi
line' || u / v, 'it''s / a', {{ ref('a/b') }} / w, "q / r"."s" / "t x"."u",
 a / (100 * 2), a / /* per */ b::numeric, t / arr[1], t / interval '1 day', a / b{{ c }}, $$ a / b $$, $x$ c / d $x$
 a // b, a /
   longname, (a / (b / c)), `p/q` / r -- done
 , m / n /* to be
 continued */ + 1 {# o / p #} {% if a / b %}
from t
"""
TRICKY_GUARDED = """select a / NULLIF(b, 0), 'data/raw', 'http://h/p', x / NULLIF(y, 0) / NULLIF(z, 0) as c,   -- e / f@
 /* c / d
 and */ p / NULLIF((q - r), 0) as k, (a + b) / NULLIF(c, 0), a / 100.0, n / f(x), n/NULLIF(m, 0), 'multi
line' || u / NULLIF(v, 0), 'it''s / a', {{ ref('a/b') }} / NULLIF(w, 0), "q / r"."s" / NULLIF("t x"."u", 0),@
 a / (100 * 2), a / /* per */ NULLIF(b, 0)::numeric, t / arr[1], t / interval '1 day', a / b{{ c }}, $$ a / b $$, $x$ c / d $x$@
 a // b, a /
   NULLIF(longname, 0), (a / NULLIF((b / NULLIF(c, 0)), 0)), `p/q` / NULLIF(r, 0) -- done@
 , m / NULLIF(n, 0) /* to be
 continued */ + 1 {# o / p #} {% if a / b %}@
from t
"""


def test_guard_touches_tokens_only(spark):
    assert patched(spark, TRICKY, patches.patch_zero_division) == TRICKY_GUARDED.replace("@", patches.GUARD_NOTE)
    again = patched(spark, TRICKY_GUARDED, patches.patch_zero_division)
    assert again == TRICKY_GUARDED


@pytest.mark.parametrize(
    "text", ["", "/", "a /", "/ a", "(a/(b", "a / (b", "'a / b", "/* a / b", "{{ a / b", "$$ a / b", "a / 'b'", "a / -b", "\n\n", "a / null"]
)
def test_guard_leaves_the_rest(spark, text):
    assert patched(spark, text, patches.patch_zero_division) == text


def test_guard_of_marks_nulls_and_long_files(spark):
    rows = [("a / b ﷐",), (None,), ("x / y,\n" * 3000,), ("'" + "a / b " * 20000 + "'",)]
    files = spark.createDataFrame([("r", str(k), t) for k, (t,) in enumerate(rows)], "repo string, file_path string, content string")
    got = {r.file_path: r.patched for r in patches.patch_zero_division(files).collect()}
    assert got["0"] == rows[0][0] and got["1"] is None and got["3"] == rows[3][0]
    assert got["2"] == ("x / NULLIF(y, 0)," + GUARD) * 3000
    found = patches.division_scan(files.where("file_path = '2'")).collect()
    assert [r.line_no for r in found] == list(range(1, 3001))


def test_division_scan_of_tokens(spark):
    rows = run(spark, TRICKY, patches.division_scan).collect()
    assert [(r.line_no, r.numerator, r.denominator) for r in rows] == [
        (1, "a", "b"), (1, "x", "y"), (1, "y", "z"), (3, "p", "(...)"), (3, "(...)", "c"), (4, "u", "v"),
        (4, "{{ ref('a/b') }}", "w"), (4, '"q / r"."s"', '"t x"."u"'), (5, "a", "b"), (6, "a", "longname"),
        (7, "a", "(...)"), (7, "b", "c"), (7, "`p/q`", "r"), (8, "m", "n"),
    ]


MODEL = """with invoices as (select * from {{ ref('stg_invoices') }}),
     shops as (
    select * from {{ ref('stg_shops') }}
)
select i.invoice_no, s.shop_no, i.ledger_code, s.opened::date as opened_on
from invoices i
left join shops s on i.shop_no = s.shop_no
"""


def test_contract_breaks(spark):
    nodes = spark.createDataFrame(
        [
            ("fct_invoices", MODEL, ["invoice_no"]),
            ("stg_invoices", "select 1", ["invoice_no", "shop_no", "ledger_key", "amount"]),
            ("stg_shops", "select 1", None),
        ],
        "name string, raw_code string, columns array<string>",
    )
    want = [("fct_invoices", "stg_invoices", "ledger_code", "ledger_key")]
    assert [tuple(r) for r in lineage.contract_breaks(nodes).collect()] == want
    messages = spark.createDataFrame(
        [('model stopped\n  column "ledger_code" does not exist in relation "stg_invoices"\n'
          '  HINT: did you want "stg_invoices.amount"',)],
        "message string",
    )
    got = lineage.contract_breaks(nodes, messages).collect()
    assert [tuple(r) for r in got] == [(*want[0][:3], "amount")]


def test_contract_breaks_in_any_spelling(spark):
    spellings = [
        'SELECT U.old_no\nFROM {{ ref("up") }} AS U',
        "WITH X AS (SELECT * FROM {{ref('up')}})\nSELECT y.old_no -- y.other\nFROM x AS y",
        "/* y.other from x y */ with x as (select * from {{ ref('up') }}) select x.old_no from x",
        "select u.old_no from {{ ref('up') }} u {# u.other #}",
    ]
    rows = [(f"n{k}", code, None) for k, code in enumerate(spellings)] + [("up", "select 1", ["New_no"])]
    nodes = spark.createDataFrame(rows, "name string, raw_code string, columns array<string>")
    got = {tuple(r) for r in lineage.contract_breaks(nodes).collect()}
    assert got == {(f"n{k}", "up", "old_no", "new_no") for k in range(4)}


def test_rename_to_a_name_with_special_characters(spark):
    rows = run(spark, "select old from t", lambda f: patches.patch_column_rename(f, "old", "new$c\\d"))
    assert rows.first().patched == "select new$c\\d from t"


def test_diffs_equal_the_library(spark):
    import difflib
    import random

    rng = random.Random(3)
    rows = []
    for k in range(120):
        old = [rng.choice("abcdef") * rng.randint(1, 3) + str(j) + "\n" for j in range(rng.randint(1, 30))]
        new = [line if rng.random() > rng.choice([0.1, 0.5]) else "X" + line for line in old]
        rows.append(("r", f"f{k}.sql", "".join(old), "".join(new)))
    frame = spark.createDataFrame(rows, "repo string, file_path string, content string, patched string")
    got = {r.file_path: r.unified_diff for r in patches.patch_diffs(frame).collect()}
    want = {
        path: "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))
        for _, path, old, new in rows if old != new
    }
    assert got == want


def test_diff_without_a_final_line_end(spark):
    frame = spark.createDataFrame([("r", "f", "a\nb", "a\nc")], "repo string, file_path string, content string, patched string")
    assert patches.patch_diffs(frame).first().unified_diff == (
        "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+c\n\\ No newline at end of file\n"
    )


def applied(old, diff):
    """The old text with a unified diff applied."""
    lines, out, at = diffs._lines(old), [], 0
    body = re.sub(r"\n\\ No newline at end of file\n", "\0\n", diff).split("\n")[2:-1]
    for line in body:
        line = line[:-1] if line.endswith("\0") else line + "\n"
        if line.startswith("@@"):
            start, _, count = line[4:].split(" ")[0].partition(",")
            start = int(start) - (count != "0")
            out += lines[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert lines[at] == line[1:]
            at += 1
            out += [line[1:]] if line[0] == " " else []
    return "".join(out + lines[at:])


def test_diffs_of_any_two_texts(spark):
    import random

    rng = random.Random(11)
    rows = []
    for k in range(300):
        old = [rng.choice("abcdefgh" if k % 2 else "ab") + "\n" for _ in range(rng.randint(0, 40))]
        new = [line for line in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 6)):
            new.insert(rng.randint(0, len(new)), rng.choice("abxyz") + "\n")
        rng.random() < 0.2 and rng.shuffle(new)
        texts = ["".join(old), "".join(new)]
        rows.append((k, *[t[:-1] if rng.random() < 0.3 else t for t in texts]))
    frame = spark.createDataFrame([*rows, (900, None, "a"), (901, "a\n", None), (902, None, None), (903, "a\x85b\x0cc\n", "a\x85b\n")], "id int, content string, patched string")
    got = {r.id: r.unified_diff for r in patches.file_diffs(frame.withColumn("file_path", patches.F.lit("f"))).collect()}
    assert set(got) == {k for k, old, new in rows if old != new} | {900, 901, 903}
    for k, old, new in rows:
        if old != new:
            assert applied(old, got[k]) == new
    assert got[900] == "--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n+a\n\\ No newline at end of file\n"
    assert got[903] == "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\x85b\x0cc\n+a\x85b\n"


def test_long_diffs_end_soon():
    import time

    start = time.time()
    old = "".join(f"line {k}\n" for k in range(100_000))
    new = "".join(f"other {k}\n" for k in range(100_000))
    assert diffs.unified(old, new, "f").count("\n") == 200_003
    assert diffs.unified(old, old.replace("line 5000\n", ""), "f").count("\n") == 10
    assert diffs.unified(old, "x\n" + "".join(reversed(old.splitlines(True))), "f").count("\n") > 100_000
    assert diffs.unified("a\nb\n" * 50_000, "b\na\n" * 50_000 + "c\n", "f")
    assert time.time() - start < 20


def test_plan_by_framework_or_category(spark):
    rows = [("dbt-core", None), ("custom-sql", None), ("airflow-native", None), (None, "STRUCTURAL_SCHEMA_DRIFT"),
            (None, "UNKNOWN"), ("terraform", "TRANSIENT_OOM")]
    requests = spark.createDataFrame(
        [(f, c, "a/b.sql", "old", "new", "t", "1Gi") for f, c in rows],
        "framework string, failure_category string, file_path string, old_column string, new_column string, task_id string, new_memory string",
    )
    got = [(r.status, r.patch_kind, r.error) for r in patches.patch_plan(requests).collect()]
    assert got == [
        ("SUCCESS", "rename", None), ("SUCCESS", "guard", None), ("SUCCESS", "memory", None), ("SUCCESS", "rename", None),
        ("FAILED", None, "no patcher for framework (none)"), ("FAILED", None, "no patcher for framework terraform"),
    ]


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame(
        [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("e", "d"), ("e", "a")],
        "node string, parent string",
    )
    got = {(r.node, r.ancestor): r.depth for r in lineage.lineage_closure(edges).collect()}
    assert got == {
        ("d", "b"): 1, ("d", "c"): 1, ("b", "a"): 1, ("c", "a"): 1, ("d", "a"): 2, ("x", "y"): 1, ("y", "x"): 1,
        ("x", "x"): 2, ("y", "y"): 2, ("e", "d"): 1, ("e", "a"): 1, ("e", "b"): 2, ("e", "c"): 2,
    }
    broken = spark.createDataFrame([("a",)], "node string")
    hit = lineage.blast_radius(edges, broken).first()
    assert (hit.node, hit.n_downstream, hit.reach) == ("a", 4, 2)


def test_closure_of_a_long_chain_takes_few_rounds(spark):
    from faultline import session
    from faultline.sources import objects

    edges = spark.range(1, 1001).selectExpr("id as node", "id - 1 as parent")
    got = lineage.lineage_closure(edges)
    rounds = {k.split("/")[0] for k in objects.Store(session._HANDED_OUT[-1]).below("") if k.startswith("reach=")}
    assert len(rounds) <= 12
    assert got.count() == 1000 * 1001 // 2
    assert got.where("node - ancestor <> depth").count() == 0
