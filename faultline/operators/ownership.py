"""Who owns the failing code: five ways to find out, the first that works wins.

Each way is resolved once per distinct task, tag list or DAG and joined back by
equality, so attempts are never compared with manifest nodes pairwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import coordinates as C


@dataclass(frozen=True)
class OwnerDefaults:
    """Answers of the ways that carry none of their own."""

    repo_name: str = "analytics-dbt"
    repo_url: str = "https://git.example.com/analytics-dbt"
    branch: str = "main"
    channel: str = "#data-platform-alerts"
    env_team: str = "@data-engineering"
    manifest_team: str = "@analytics-engineering"
    tag_team: str = "@oncall"
    catalog_team: str = "@data-platform"
    default_team: str = "@oncall-data-sre"


# Names of the five ways, in order of precedence.
METHODS = ("environment", "manifest", "dag_tag", "catalog", "default")


def newest_manifest(nodes: DataFrame) -> DataFrame:
    """The nodes of the newest manifest of each project, where manifests have ``project`` and ``run_id``."""
    if not {"project", "run_id"} <= set(nodes.columns):
        return nodes
    newest = nodes.groupBy(F.col("project").alias("_p")).agg(F.max("run_id").alias("_r"))
    return nodes.join(
        newest, F.col("project").eqNullSafe(F.col("_p")) & F.col("run_id").eqNullSafe(F.col("_r")), "left_semi"
    )


# Letters of a gram of the index of node ids.
GRAM = 4


def _grams(text: Column, size: Column) -> Column:
    """The different pieces of a text of one size; the empty one for size 0."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


# A gram is common when it holds more than this part of the index, and more than this many nodes. So there are at most as
# many common grams as the first says, whatever the size of the index.
COMMON_PART = 1000
COMMON_NODES = 10_000


def _dealt(
    index: DataFrame, frequency: DataFrame, rarest: DataFrame, scope: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``index`` and ``rarest`` with the ``_part`` of their gram in which they meet.

    Entries of common grams that are the rarest of no task id, as the words that all ids share, are left out. Those of
    the others are dealt to parts of about equal size, so no task reads all nodes of a gram.
    """
    key = [*scope, "_gram"]
    size = frequency.agg(F.greatest(F.sum("_nodes") / COMMON_PART, F.lit(COMMON_NODES))).scalar()
    is_common = F.col("_nodes") > size
    parts = F.ceil(F.col("_nodes") / size).cast("int")
    wanted = rarest.where(is_common).select(*key).distinct().withColumn("_wanted", F.lit(True))
    common = frequency.where(is_common).select(*key, parts.alias("_parts")).join(F.broadcast(wanted), key, "left")
    dealt = (
        index.join(F.broadcast(common), key, "left")
        .where("_parts IS NULL OR _wanted")
        .withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"), F.lit(0)))
        .drop("_parts", "_wanted")
    )
    last = F.when(is_common, parts - 1).otherwise(0)
    asked = rarest.withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_nodes")
    return dealt, asked


def manifest_match(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each distinct (``task_id``, ``hint``): the first manifest node whose id
    contains the task id or whose path equals the hint.

    Only the newest manifest of a project counts. Where ``tasks`` names a ``project``,
    its nodes alone are looked at; else the first project by name that has a match
    answers. Containment is found by an index of grams: a node whose id contains a task id contains the
    rarest gram of it, so the nodes of that gram alone are compared with the task id. ``nodes`` has ``ord``, ``node_id``,
    ``original_file_path``.
    """
    scope = ["project"] if "project" in tasks.columns and "project" in nodes.columns else []
    wanted = tasks.select(*scope, "task_id", C.or_default(F.col("hint"), F.lit(None)).alias("hint")).distinct()
    ids = wanted.select(*scope, "task_id").distinct()
    project = F.col("project") if "project" in nodes.columns else F.lit("")
    node = F.struct(project.alias("project"), "ord", "node_id", "original_file_path")
    # Files of many nodes are small, and entries of the index many: they are made in more tasks than read.
    nodes = newest_manifest(nodes).select(*scope, node.alias("_node")).repartition("_node")
    # Ids shorter than a gram are one themselves; there are at most GRAM + 1 sizes.
    size = F.least(F.length("task_id"), F.lit(GRAM))
    sizes = ids.agg(F.collect_set(size)).scalar()
    index = (
        nodes.withColumn("_size", F.explode(sizes)).where("_size <= length(_node.node_id)")
        .select(*scope, "_node", F.explode(_grams(F.col("_node.node_id"), F.col("_size"))).alias("_gram"))
    )
    frequency = index.groupBy(*scope, "_gram").agg(F.count("*").alias("_nodes"))
    parts = ids.where("task_id IS NOT NULL").select(*scope, "task_id", F.explode(_grams(F.col("task_id"), size)).alias("_gram"))
    rarest = (
        parts.join(frequency, [*scope, "_gram"], "left")
        .groupBy(*scope, "task_id")
        # A gram that no node has is the rarest.
        .agg(F.min(F.struct(F.coalesce("_nodes", F.lit(0)).alias("nodes"), "_gram")).alias("_rarest"))
        .where("_rarest.nodes > 0")
        .select(*scope, "task_id", F.col("_rarest._gram").alias("_gram"), F.col("_rarest.nodes").alias("_nodes"))
    )
    dealt, asked = _dealt(index, frequency, rarest, scope)
    by_id = (
        dealt.join(asked, [*scope, "_gram", "_part"])
        .where(F.contains("_node.node_id", F.col("task_id")))
        .groupBy(*scope, "task_id")
        .agg(F.min("_node").alias("_by_id"))
    )
    by_path = (
        nodes.where("_node.original_file_path IS NOT NULL")
        .groupBy(*scope, F.col("_node.original_file_path").alias("hint"))
        .agg(F.min("_node").alias("_by_path"))
    )
    first = F.least("_by_id", "_by_path")
    return (
        wanted.join(by_id, [*scope, "task_id"], "left")
        .join(by_path, [*scope, "hint"], "left")
        .where(first.isNotNull())
        .select(
            *scope,
            "task_id",
            "hint",
            first["node_id"].alias("node_id"),
            F.coalesce(first["original_file_path"], F.col("hint")).alias("node_path"),
        )
    )


def tag_match(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each distinct tag list: the first ``repo:`` tag the catalog knows."""
    tags = tasks.select("dag_tags").where("dag_tags IS NOT NULL").distinct()
    named = (
        tags.select("dag_tags", F.posexplode("dag_tags").alias("_pos", "_tag"))
        .where(F.startswith("_tag", F.lit("repo:")))
        .withColumn("repo_name", F.substring_index("_tag", "repo:", -1))
    )
    entry = F.struct("_pos", *[c for c in catalog.columns if c != "matching_dags"])
    return (
        named.join(catalog, "repo_name")
        .groupBy("dag_tags")
        .agg(F.min_by(entry, "_pos").alias("tagged"))
    )


def catalog_match(catalog: DataFrame) -> DataFrame:
    """For each DAG: the first catalog entry that lists it."""
    entry = F.struct("ord", *[c for c in catalog.columns if c not in ("ord", "matching_dags")])
    return (
        catalog.select(entry.alias("_entry"), F.explode("matching_dags").alias("dag_id"))
        .groupBy("dag_id")
        .agg(F.min_by("_entry", "_entry.ord").alias("listed"))
    )


def _joined_path(folder: Column, name: Column) -> Column:
    slash = F.when((folder == "") | F.endswith(folder, F.lit("/")), "").otherwise("/")
    return F.concat(folder, slash, name)


def resolve_owner(
    tasks: DataFrame,
    nodes: DataFrame,
    catalog: DataFrame,
    defaults: OwnerDefaults = OwnerDefaults(),
) -> DataFrame:
    """Add repository, branch, path, method, team, channel, framework and tier.

    ``tasks`` has ``dag_id``, ``task_id``, ``env_vars`` (map), ``dag_tags`` (array)
    and ``hint`` (failing file), and may have ``project``, which then scopes the
    manifest. Every task gets exactly one owner.
    """
    d = defaults
    env = {"_repo": F.element_at("env_vars", "GIT_SYNC_REPO"), "_branch": F.element_at("env_vars", "GIT_SYNC_BRANCH")}
    scope = ["project"] if "project" in tasks.columns and "project" in nodes.columns else []
    asked = ["dag_id", "task_id", "dag_tags", "_hint", "_repo", "_branch", *scope]
    keyed = tasks.withColumns({"_hint": C.or_default(F.col("hint"), F.lit(None)), **env})
    # Attempts ask the same few questions: each is answered once. A struct as the key
    # makes null fields equal.
    keyed = keyed.select(*tasks.columns, F.struct(*asked).alias("_asked"))
    distinct = keyed.select("_asked").distinct().select("_asked", "_asked.*").withColumnRenamed("_hint", "hint")
    # Tasks that name their repository need no manifest.
    by_node = manifest_match(distinct.where("_repo IS NULL"), nodes)
    by_node = by_node.withColumnsRenamed({c: f"_m_{c}" for c in (*scope, "task_id", "hint")})
    same = F.col("_repo").isNull() & (F.col("task_id") == F.col("_m_task_id")) & F.col("hint").eqNullSafe(F.col("_m_hint"))
    for column in scope:
        same = same & (F.col(column) == F.col(f"_m_{column}"))
    rows = (
        distinct.join(by_node, same, "left")
        .join(tag_match(distinct, catalog), "dag_tags", "left")
        .join(catalog_match(catalog), "dag_id", "left")
    )
    env_repo = F.col("_repo")
    tier = (
        F.when(env_repo.isNotNull(), 1)
        .when(F.col("node_id").isNotNull(), 2)
        .when(F.col("tagged").isNotNull(), 3)
        .when(F.col("listed").isNotNull(), 4)
        .otherwise(5)
    )
    rows = rows.withColumn("tier", tier)

    def pick(*values: Column | str) -> Column:
        choices = [F.lit(v) if isinstance(v, str) else v for v in values]
        case = F.when(F.col("tier") == 1, choices[0])
        for i, value in enumerate(choices[1:], start=2):
            case = case.when(F.col("tier") == i, value)
        return case

    tagged, listed = F.col("tagged"), F.col("listed")
    own_file = F.concat(F.col("task_id"), F.lit(".sql"))
    model_file = F.coalesce(F.col("hint"), F.concat(F.lit("models/"), own_file))
    subpath = F.coalesce(listed["code_subpath"], F.lit(""))
    answers = rows.select(
        "_asked",
        pick(C.repo_from_url(env_repo), d.repo_name, tagged["repo_name"], listed["repo_name"], d.repo_name).alias("repo_name"),
        pick(env_repo, d.repo_url, tagged["repo_url"], listed["repo_url"], d.repo_url).alias("repo_url"),
        pick(
            F.coalesce("_branch", F.lit(d.branch)),
            d.branch,
            F.coalesce(tagged["default_branch"], F.lit(d.branch)),
            F.coalesce(listed["default_branch"], F.lit(d.branch)),
            d.branch,
        ).alias("default_branch"),
        pick(
            model_file,
            F.col("node_path"),
            F.coalesce(F.col("hint"), tagged["code_subpath"], F.lit("")),
            F.coalesce(F.col("hint"), _joined_path(subpath, own_file)),
            model_file,
        ).alias("target_file_path"),
        pick(*METHODS).alias("discovery_method"),
        pick(
            d.env_team,
            d.manifest_team,
            F.coalesce(tagged["team_owner"], F.lit(d.tag_team)),
            F.coalesce(listed["team_owner"], F.lit(d.catalog_team)),
            d.default_team,
        ).alias("team_owner"),
        pick(
            d.channel,
            d.channel,
            F.coalesce(tagged["slack_channel"], F.lit(d.channel)),
            F.coalesce(listed["slack_channel"], F.lit(d.channel)),
            d.channel,
        ).alias("channel"),
        F.coalesce(
            F.when(F.col("tier") == 3, tagged["framework"]), F.when(F.col("tier") == 4, listed["framework"])
        ).alias("framework"),
        "tier",
    )
    return keyed.join(answers, "_asked").drop("_asked")
