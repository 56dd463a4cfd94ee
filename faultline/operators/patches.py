"""Code patches over source files, one row per file.

Files have ``repo``, ``file_path`` and ``content``. Edits and the diffs of edits are column
expressions; ``file_diffs`` compares any two texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from faultline.functions import diffs, text as X, tokens

# What the edits look for.
ANY_DIVISION = r"(\w+)\s*/\s*(\w+)"
MEMORY_SETTING = r"""('memory':\s*'[0-9]+[A-Za-z]+'|"memory":\s*"[0-9]+[A-Za-z]+")"""
MEMORY_WORDS = ("limits", "resources", "memory")
MEMORY_UNITS = ("Mi", "Gi")

GUARD_NOTE = " -- divisor guarded against zero"
MEMORY_NOTE = "  # memory limit raised for good"
# What the catalog calls a framework, by the patch that fits it (fixed values).
FRAMEWORKS = {
    "rename": ("dbt-core", "dbt"),
    "guard": ("custom-sql",),
    "memory": ("airflow-native", "airflow-dag"),
}
# Unchanged lines shown around a change.
CONTEXT = 3
NO_LINE_END = "\n\\ No newline at end of file\n"


def _edit_lines(content: Column, applies, edit, note: str) -> Column:
    """Edit the lines that apply; a changed line loses trailing blanks and gains
    ``note``."""

    def one(line: Column) -> Column:
        edited = edit(line)
        marked = F.concat(F.regexp_replace(edited, r"\s+\z", ""), F.lit(note + "\n"))
        return F.when(applies(line) & (edited != line), marked).otherwise(line)

    return F.array_join(F.transform(X.lines_with_ends(content), one), "")


def patch_column_rename(
    files: DataFrame, old: Column | str, new: Column | str, whole_words: bool = True
) -> DataFrame:
    """Replace a column name. Names are constants, or columns of ``files``.

    ``whole_words=False`` also rewrites longer names that contain the old one.
    """
    old = F.lit(old) if isinstance(old, str) else old
    new = F.lit(new) if isinstance(new, str) else new
    if whole_words:
        pattern = F.concat(F.lit(r"\b\Q"), old, F.lit(r"\E\b"))
        literal = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        patched = F.regexp_replace(F.col("content"), pattern, literal)
    else:
        patched = F.replace(F.col("content"), old, new)
    return files.withColumn("patched", patched)


def patch_zero_division(files: DataFrame, literal_too: bool = False) -> DataFrame:
    """Guard divisors with ``NULLIF``.

    Divisors that name a column are guarded, alone or in brackets, wherever they stand in
    a chain; literals, calls, strings, comments and templates are left alone, and a second run
    changes nothing. ``literal_too`` instead guards the word after every slash on
    lines that are not comments, whatever it is.
    """
    if not literal_too:
        return tokens.guard_divisors(files, "content", "patched", GUARD_NOTE)

    def applies(line: Column) -> Column:
        return F.contains(line, F.lit("/")) & ~F.startswith(X.strip(line), F.lit("--"))

    def edit(line: Column) -> Column:
        return F.regexp_replace(line, ANY_DIVISION, "$1 / NULLIF($2, 0)")

    patched = _edit_lines(F.col("content"), applies, edit, GUARD_NOTE)
    return files.withColumn(
        "patched",
        F.when(F.contains("content", F.lit("/")), patched).otherwise(F.col("content")),
    )


def patch_memory_limit(files: DataFrame, new_memory: str = "4096Mi") -> DataFrame:
    """Rewrite quoted memory settings on resource lines."""

    def any_of(line: Column, words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(line, F.lit(word))
        return found

    def applies(line: Column) -> Column:
        return any_of(line, MEMORY_WORDS) & any_of(line, MEMORY_UNITS)

    def edit(line: Column) -> Column:
        return F.regexp_replace(line, MEMORY_SETTING, f"'memory': '{new_memory}'")

    patched = _edit_lines(F.col("content"), applies, edit, MEMORY_NOTE)
    return files.withColumn(
        "patched",
        F.when(F.contains("content", F.lit("memory")), patched).otherwise(F.col("content")),
    )


def affected_files(owners: DataFrame, files: DataFrame) -> DataFrame:
    """Files that incidents point at, with ``n_incidents``.

    ``owners`` has ``repo_name`` and ``target_file_path``; incidents are counted per
    file before they meet the files.
    """
    targets = owners.groupBy(
        F.col("repo_name").alias("repo"), F.col("target_file_path").alias("file_path")
    ).agg(F.count("*").alias("n_incidents"))
    return files.join(targets, ["repo", "file_path"])


def unified_diff(old: str, new: str, places: str, path: str) -> Column:
    """The unified diff of two arrays of lines with their ends and of equal length.

    ``places`` is the array of positions (from 0) at which they differ. All four are
    names of columns.
    """
    gap = 2 * CONTEXT + 1
    last = F.size(old) - 1
    begins = F.filter(places, lambda p, i: (i == 0) | (p - F.get(places, i - 1) > gap))
    ends = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) - p > gap))

    def marked(sign: str, line: Column) -> Column:
        whole = F.concat(F.lit(sign), line)
        return F.when(F.endswith(line, F.lit("\n")), whole).otherwise(F.concat(whole, F.lit(NO_LINE_END)))

    def step(state: Column, i: Column) -> Column:
        before, after = F.get(old, i), F.get(new, i)
        same = before == after
        # Lines that change together stand together, the old ones first.
        return F.struct(
            F.when(same, F.concat(state["out"], state["minus"], state["plus"], marked(" ", before)))
            .otherwise(state["out"]).alias("out"),
            F.when(same, "").otherwise(F.concat(state["minus"], marked("-", before))).alias("minus"),
            F.when(same, "").otherwise(F.concat(state["plus"], marked("+", after))).alias("plus"),
        )

    def hunk(begin: Column, end: Column) -> Column:
        first, to = F.greatest(begin - CONTEXT, F.lit(0)), F.least(end + CONTEXT, last)
        size = to - first + 1
        place = F.concat((first + 1).cast("string"), F.when(size == 1, "").otherwise(F.concat(F.lit(","), size.cast("string"))))
        empty = F.struct(F.lit("").alias("out"), F.lit("").alias("minus"), F.lit("").alias("plus"))
        body = F.aggregate(
            F.sequence(first, to), empty, step, lambda s: F.concat(s["out"], s["minus"], s["plus"])
        )
        return F.concat(F.lit("@@ -"), place, F.lit(" +"), place, F.lit(" @@\n"), body)

    return F.concat(
        F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), F.array_join(F.zip_with(begins, ends, hunk), "")
    )


def patch_diffs(patched: DataFrame) -> DataFrame:
    """Unified diff of each changed file; unchanged files drop out first.

    Every edit here keeps the number of lines, so lines pair by position.
    """
    lines = patched.where("content <> patched").select(
        "*",
        F.inline(F.array(F.struct(X.lines_with_ends(F.col("content")).alias("_old"), X.lines_with_ends(F.col("patched")).alias("_new")))),
    )
    differ = F.filter(F.sequence(F.lit(0), F.size("_old") - 1), lambda i: F.get("_old", i) != F.get("_new", i))
    placed = lines.select("*", F.inline(F.array(F.struct(differ.alias("_places")))))
    return placed.withColumn("unified_diff", unified_diff("_old", "_new", "_places", "file_path")).drop("_old", "_new", "_places")


def file_diffs(files: DataFrame, before: str = "content", after: str = "patched", path: str = "file_path") -> DataFrame:
    """Unified diff of any two texts per row, in ``unified_diff``; rows with equal texts drop out.

    Lines may be inserted, deleted and moved. A null text is an empty one. Each pair is handled within its row; only the texts and the path
    go to Python.
    """

    def run(batches):
        for batch in batches:
            yield batch[["_row"]].assign(
                unified_diff=[diffs.unified(o, n, p) for o, n, p in zip(batch["_old"], batch["_new"], batch["_path"])]
            )

    texts = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((before, "_old"), (after, "_new"), (path, "_path"))]
    changed = files.where(~F.coalesce(before, F.lit("")).eqNullSafe(F.coalesce(after, F.lit(""))))
    kind = StructType([StructField("_row", files.schema, False), StructField("unified_diff", StringType())])
    rows = changed.select(F.struct(*files.columns).alias("_row"), *texts).mapInPandas(run, kind)
    return rows.select("_row.*", "unified_diff")


def patch_kind(framework: Column | str, category: Column | str | None = None) -> Column:
    """Which patch fits: by framework, or without one by the failure category."""
    framework = F.col(framework) if isinstance(framework, str) else framework
    known = reduce(
        lambda case, kind: case.when(framework.isin(*FRAMEWORKS[kind]), kind),
        list(FRAMEWORKS)[1:],
        F.when(framework.isin(*FRAMEWORKS["rename"]), "rename"),
    )
    if category is None:
        return known
    by_category = (
        F.when(F.col(category) == "STRUCTURAL_SCHEMA_DRIFT", "rename")
        .when(F.col(category) == "STRUCTURAL_DIVISION_BY_ZERO", "guard")
        .when(F.col(category) == "TRANSIENT_OOM", "memory")
    )
    return F.when(framework.isNull(), by_category).otherwise(known)


def patch_plan(requests: DataFrame) -> DataFrame:
    """Kind, branch, title, body and status for each requested patch.

    ``requests`` has ``framework``, ``file_path``, ``old_column``, ``new_column``,
    ``task_id`` and ``new_memory``, and may have ``failure_category``, which decides
    where the owner has no framework. A framework without a patcher fails.
    """
    name = F.substring_index("file_path", "/", -1)
    kind = patch_kind("framework", "failure_category" if "failure_category" in requests.columns else None)
    requests = requests.withColumn("patch_kind", kind)
    rename, guard, memory = (F.col("patch_kind") == k for k in FRAMEWORKS)
    reason = (
        F.when(rename, F.format_string("The upstream model declares `%s`; `%s` is gone. Every whole-word use of the old name in `%s` is replaced.", "new_column", "old_column", "file_path"))
        .when(guard, F.format_string("Divisors in `%s` can be zero. Each is wrapped in NULLIF, so such rows become null instead of failing the job.", "file_path"))
        .when(memory, F.format_string("Task `%s` ran out of memory. Its limit in `%s` becomes %s.", "task_id", "file_path", "new_memory"))
    )
    return requests.withColumns(
        {
            "status": F.when(F.col("patch_kind").isNotNull(), "SUCCESS").otherwise("FAILED"),
            "branch_name": F.when(rename, F.concat(F.lit("fix/dbt-rename-"), "new_column"))
            .when(guard, F.lit("fix/sql-nullif-guard"))
            .when(memory, F.concat(F.lit("infra/raise-memory-"), "task_id")),
            "title": F.when(
                rename, F.format_string("fix(dbt): use %s for %s in %s", "new_column", "old_column", name)
            )
            .when(guard, F.format_string("fix(sql): guard divisors in %s", name))
            .when(memory, F.format_string("infra(dag): %s memory for task %s", "new_memory", "task_id")),
            "body": F.concat(reason, F.lit("\n\nReview the diff, merge it and clear the task.")),
            "error": F.when(
                F.col("patch_kind").isNull(),
                F.concat(F.lit("no patcher for framework "), F.coalesce("framework", F.lit("(none)"))),
            ),
        }
    )


def incident_patches(requests: DataFrame, files: DataFrame, new_memory: str = "4096Mi") -> DataFrame:
    """The patch of every incident whose file is known: plan, ``patched`` file, ``code_diff`` and ``pr_url``.

    ``requests`` has what ``patch_plan`` needs, with ``repo_name``, ``repo_url`` and
    ``target_file_path`` of the owner. Each file is patched once per kind and pair of
    names and joined back. Incidents without a file, or whose file needs no change,
    keep their plan with a null diff.
    """
    if "new_memory" not in requests.columns:
        requests = requests.withColumn("new_memory", F.lit(new_memory))
    plan = patch_plan(requests.withColumn("file_path", F.col("target_file_path")))
    job = ["repo_name", "file_path", "patch_kind", "old_column", "new_column"]
    jobs = plan.where("patch_kind IS NOT NULL").select(*job).distinct()
    found = jobs.join(files.withColumnRenamed("repo", "repo_name"), ["repo_name", "file_path"])
    edits = {
        "rename": lambda rows: patch_column_rename(rows, F.col("old_column"), F.col("new_column")),
        "guard": patch_zero_division,
        "memory": lambda rows: patch_memory_limit(rows, new_memory),
    }
    patched = reduce(
        DataFrame.unionByName, [edit(found.where(F.col("patch_kind") == kind)) for kind, edit in edits.items()]
    )
    diffs = patch_diffs(patched).select(*[F.col(c).alias(f"_{c}") for c in job], F.col("unified_diff").alias("code_diff"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in job])
    link = F.concat(F.regexp_replace("repo_url", r"(?:\.git)?/*$", ""), F.lit("/compare/"), "branch_name")
    return (
        plan.join(diffs, same, "left").drop(*[f"_{c}" for c in job])
        .withColumn("pr_url", F.when(F.col("code_diff").isNotNull(), link))
    )


def division_scan(files: DataFrame) -> DataFrame:
    """Every unguarded division by a column: where the next failure may be.

    ``numerator`` and ``denominator`` are names with their qualifiers, literals, or ``(...)`` for brackets.
    """
    some = files.where(F.contains("content", F.lit("/"))).select("repo", "file_path", "content")
    return tokens.with_divisors(some, "content").select("repo", "file_path", F.inline(tokens.divisions()))
