"""Readers and the writer of the log lake.

The lake is a directory tree with ``name=value`` folders. Readers take the root of
one source and discover the folders, so filters on them prune directories. Folder
values stay strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.sources import schemas


def _strings(names: list[str]) -> str:
    """Folder columns by name; without a declared type ``09`` would turn into 9."""
    return ", ".join(f"{name} string" for name in names)


def event_time(text: Column) -> Column:
    """ISO time with ``Z``, ``+00:00`` or ``+0000`` at the end; null when unreadable."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX")),
    )


LOG_FOLDERS = ["cluster", "dag_id", "task_id", "execution_date"]


def _attempt_logs(rows: DataFrame) -> DataFrame:
    attempt = F.regexp_extract("_metadata.file_path", r"attempt=(\d+)", 1).try_cast("int")
    return rows.select(
        F.col("value").alias("log_text"),
        *LOG_FOLDERS,
        attempt.alias("attempt"),
        object_path(F.col("_metadata.file_path")).alias("uri"),
    )


def scan_task_logs(spark: SparkSession, root: str) -> DataFrame:
    """Attempt logs, one row per object: ``log_text``, the folder values, ``attempt``
    as a number and ``uri``, as it is stored. ``attempt=N`` may be a file name or a folder."""
    reader = spark.read.schema(_strings(["value", *LOG_FOLDERS]))
    return _attempt_logs(reader.text(root, wholetext=True))


def stream_task_logs(spark: SparkSession, root: str) -> DataFrame:
    """The same logs as objects arrive."""
    reader = spark.readStream.schema(_strings(["value", *LOG_FOLDERS]))
    return _attempt_logs(reader.text(root, wholetext=True))


def with_attempt_log(attempts: DataFrame, logs: DataFrame) -> DataFrame:
    """Attach each attempt's log; a missing one shows as ``log_found = false``."""
    keys = ["cluster", "dag_id", "task_id", "execution_date", "attempt"]
    text = logs.select(*keys, "log_text", F.lit(True).alias("_found"))
    return (
        attempts.join(text, keys, "left")
        .withColumn("log_found", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def scan_cloud_events(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Structured log events. Files hold one JSON array, or with ``lines`` one event
    per line, the form that splits across tasks. Unreadable content keeps its text
    in ``corrupt``."""
    folders = ["cluster", "year", "month", "day"]
    schema = f"{schemas.CLOUD_EVENT}, corrupt string, {_strings(folders)}"
    rows = spark.read.schema(schema).json(
        root, multiLine=not lines, columnNameOfCorruptRecord="corrupt"
    )
    return rows.select(
        F.col("insertId").alias("insert_id"),
        event_time(F.col("timestamp")).alias("ts"),
        "severity",
        F.col("resource.type").alias("resource_type"),
        F.col("resource.labels").alias("labels"),
        F.col("jsonPayload").alias("payload"),
        # A corrupt row has no other field; naming one lets callers query this alone.
        F.when(F.col("timestamp").isNull(), F.col("corrupt")).alias("corrupt"),
        *folders,
    )


def scan_metrics(spark: SparkSession, root: str, metric: str | None = None, lines: bool = False) -> DataFrame:
    """Metric samples, one row each. ``metric`` selects by folder or by the
    series' own name; unreadable values are null with ``raw_value`` kept."""
    folders = ["cluster", "metric"]
    rows = spark.read.schema(f"{schemas.METRICS}, {_strings(folders)}").json(
        root, multiLine=not lines
    )
    samples = rows.select(*folders, F.explode("data.result").alias("_series")).select(
        *folders,
        F.col("_series.metric").alias("labels"),
        F.explode("_series.values").alias("_point"),
    ).select(
        *folders,
        "labels",
        F.timestamp_millis((F.col("_point")[0].try_cast("double") * 1000).cast("long")).alias("ts"),
        F.col("_point")[1].alias("raw_value"),
        F.col("_point")[1].try_cast("double").alias("value"),
    )
    if metric is None:
        return samples
    return samples.where((F.col("metric") == metric) | (F.col("labels")["__name__"] == metric))


def scan_manifest(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Model nodes of all manifests, one row each."""
    folders = ["project", "run_id"]
    rows = spark.read.schema(f"{schemas.MANIFEST}, {_strings(folders)}").json(
        root, multiLine=not lines, pathGlobFilter="*" if lines else "manifest.json"
    )
    return rows.select(
        *folders, F.posexplode(F.map_entries("nodes")).alias("ord", "_entry")
    ).select(
        *folders,
        "ord",
        F.col("_entry.key").alias("node_id"),
        F.col("_entry.value.name").alias("name"),
        F.col("_entry.value.resource_type").alias("resource_type"),
        F.col("_entry.value.original_file_path").alias("original_file_path"),
        F.col("_entry.value.raw_code").alias("raw_code"),
        F.col("_entry.value.depends_on.nodes").alias("depends_on"),
        F.map_keys("_entry.value.columns").alias("columns"),
    )


def manifest_edges(nodes: DataFrame) -> DataFrame:
    """(``node``, ``parent``) dependencies of manifest nodes."""
    return nodes.select(F.col("node_id").alias("node"), F.explode("depends_on").alias("parent"))


def scan_run_results(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Results of all model runs, one row each."""
    folders = ["project", "run_id"]
    rows = spark.read.schema(f"{schemas.RUN_RESULTS}, {_strings(folders)}").json(
        root, multiLine=not lines, pathGlobFilter="*" if lines else "run_results.json"
    )
    return rows.select(*folders, F.explode("results").alias("_r")).select(
        *folders,
        F.col("_r.unique_id").alias("unique_id"),
        F.col("_r.status").alias("status"),
        F.col("_r.timing").alias("timing"),
        F.col("_r.thread_id").alias("thread_id"),
        F.col("_r.message").alias("message"),
        F.col("_r.adapter_response.code").alias("code"),
        F.col("_r.adapter_response.rows_affected").alias("rows_affected"),
    )


def result_bundle(results: DataFrame, files: DataFrame) -> DataFrame:
    """Attach the source of the model each result is about, by model file name."""
    model = F.substring_index("unique_id", ".", -1)
    named = files.withColumn(
        "_model", F.regexp_extract("file_path", r"([^/]+)\.sql$", 1)
    ).select("_model", "repo", "file_path", "content")
    return results.withColumn("_model", model).join(named, "_model", "left").drop("_model")


def object_path(uri: Column) -> Column:
    """A path as it is stored; readers report it percent-encoded. A plus stays one."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def scan_repo_files(spark: SparkSession, root: str, pattern: str = "*.sql") -> DataFrame:
    """Source files below ``root``/<repo>/, whole: ``repo``, ``file_path``, ``content``."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    anchor = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.substring_index(object_path(F.col("_metadata.file_path")), f"/{anchor}/", -1)
    return rows.select(
        F.substring_index(below, "/", 1).alias("repo"),
        F.regexp_extract(below, "^[^/]+/(.*)$", 1).alias("file_path"),
        F.col("value").alias("content"),
    )


def load_service_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of the service catalog in file order; empty when the file is
    absent."""
    if _exists(spark, path):
        rows = spark.read.schema(schemas.CATALOG).json(path, multiLine=True)
    else:
        rows = spark.createDataFrame([], schemas.CATALOG)
    return rows.select(F.posexplode(F.map_entries("repositories")).alias("ord", "_e")).select(
        "ord", "_e.value.*"
    )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.format("binaryFile").load(path).select("path").limit(1).count())
    except Exception as error:  # the reader reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def scan_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Failure alerts, one JSON document per line."""
    return spark.read.schema(schemas.ALERT).json(path)


def stream_alerts(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same alerts as they arrive."""
    reader = spark.readStream.schema(schemas.ALERT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def objects(spark: SparkSession, root: str) -> DataFrame:
    """Objects below ``root``: ``path``, ``length``, ``modificationTime``. Content is
    not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )


def list_objects(spark: SparkSession, root: str, prefix: str = "", max_keys: int = 50) -> DataFrame:
    """The first ``max_keys`` objects whose key starts with the string ``prefix``, by
    key: ``key``, ``path``, ``length``, ``modificationTime``.

    The folders that ``prefix`` names whole bound the listing; the rest of it, such
    as the begin of a name, filters the keys.
    """
    root, prefix = root.rstrip("/"), prefix.lstrip("/")
    folder = prefix.rpartition("/")[0]
    anchor = f"{root}/{folder}".rstrip("/")
    base = root.rsplit("/", 1)[-1]
    key = F.substring_index("path", f"/{base}/", -1)
    listed = objects(spark, anchor).select(key.alias("key"), "path", "length", "modificationTime")
    return listed.where(F.startswith("key", F.lit(prefix))).orderBy("key").limit(max_keys)


def inventory(listed: DataFrame, group: Column) -> DataFrame:
    """Number of objects and bytes per group."""
    return listed.groupBy(group.alias("part")).agg(
        F.count("*").alias("n_objects"), F.sum("length").alias("n_bytes")
    )


# Rows of one text object: such objects are read whole, by one task each.
TEXT_ROWS = 5_000
# Objects of text and JSON that a task keeps open; these need little memory, those of Parquet hold a row group each.
OPEN_OBJECTS = 32
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_lake(df: DataFrame, root: str, keys: list[str], fmt: str = "parquet") -> None:
    """Write objects under ``name=value`` folders, replacing the folders touched.

    Rows are rebalanced on the keys: small folders share a task, a folder with very
    many rows is split over several, so no task writes all of a hot one. A task with few folders
    of text or JSON writes rows as they come, others sort them. Text objects hold at most ``TEXT_ROWS`` rows.
    """
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys).mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").format(fmt)
    if fmt == "text":
        writer = writer.option("maxRecordsPerFile", TEXT_ROWS)
    conf = df.sparkSession.conf
    before = conf.get(_WRITERS)
    if fmt in ("text", "json"):
        conf.set(_WRITERS, OPEN_OBJECTS)
    try:
        writer.save(root)
    finally:
        conf.set(_WRITERS, before)


def parse_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON column; bad text yields null ``parsed``, an ``error`` and the
    ``raw`` text."""
    parsed = F.from_json(column, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = F.col("_parsed").isNull() | F.col("_parsed._bad").isNotNull()
    return (
        rows.withColumn("_parsed", parsed)
        .withColumn("error", F.when(bad, "Invalid JSON"))
        .withColumn("raw", F.when(bad, F.col(column)))
        .withColumn("parsed", F.when(~bad, F.col("_parsed")))
        .drop("_parsed")
    )


def decode_text(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Decode bytes as UTF-8; invalid sequences become the replacement character."""
    return rows.withColumn(name, F.make_valid_utf8(F.col(column).cast("string")))
