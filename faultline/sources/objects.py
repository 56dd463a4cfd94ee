"""Objects of the lake by their keys: read what is asked for, write what has changed.

The file readers of Spark list a tree before they read it. Here an address names its object, so nothing
is listed: as a data source, whose filters on the keys become one partition for some objects each, or
for a table of addresses, whose tasks open the objects. Writing puts each object at its key, whole or not at all.

Tasks reach the store through ``pyarrow.fs``: local folders, HDFS, S3 and Google storage.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FOLDERS = ("cluster", "dag_id", "task_id", "execution_date")
KEYS = (*FOLDERS, "attempt")
LOGS = "log_text string, cluster string, dag_id string, task_id string, execution_date string, attempt int, uri string"
# Objects that one partition reads.
PER_PARTITION = 64
_PUSH = "spark.sql.python.filterPushdown.enabled"
_ATTEMPT = re.compile(r"attempt=(\d+)(?:\.log)?$")


def log_key(*columns: str) -> Column:
    """The key of an attempt's log below the root, from the columns of its address; null if one is missing."""
    names = columns or KEYS
    folders = [F.concat(F.lit(f"{name}="), F.col(c).cast("string"), F.lit("/")) for name, c in zip(FOLDERS, names)]
    return F.concat(*folders, F.lit("attempt="), F.col(names[4]).cast("string"), F.lit(".log"))


class Store:
    """A root folder in any file system."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.files, self.base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", self.root))

    def path(self, key: str) -> str:
        return posixpath.join(self.base, key)

    def uri(self, path: str) -> str:
        return f"{self.root}/{posixpath.relpath(path, self.base)}"

    def read(self, key: str) -> bytes | None:
        """The object at a key, or nothing."""
        try:
            with self.files.open_input_stream(self.path(key), compression=None) as stream:
                return stream.read()
        except FileNotFoundError:
            return None

    def below(self, folder: str) -> list[str]:
        """Keys of all objects below a folder; none if it is absent."""
        found = self.files.get_file_info(fs.FileSelector(self.path(folder), allow_not_found=True, recursive=True))
        return sorted(posixpath.relpath(f.path, self.base) for f in found if f.type == fs.FileType.File)

    def holds(self, key: str, content: bytes) -> bool:
        """Whether the object is there with this content; it is read only if its size is the same."""
        info = self.files.get_file_info(self.path(key))
        if info.type != fs.FileType.File or info.size != len(content):
            return False
        return hashlib.sha256(self.read(key) or b"").digest() == hashlib.sha256(content).digest()

    def write(self, key: str, content: bytes) -> None:
        """Put an object at its key. Readers see the old one or the whole new one."""
        path = self.path(key)
        renames = self.files.type_name in ("local", "hdfs")
        if renames:
            self.files.create_dir(posixpath.dirname(path), recursive=True)
        place = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}") if renames else path
        with self.files.open_output_stream(place, compression=None) as stream:
            stream.write(content)
        if renames:
            self.files.move(place, path)

    def delete(self, key: str) -> None:
        try:
            self.files.delete_file(self.path(key))
        except FileNotFoundError:
            pass


def _address(key: str) -> tuple | None:
    """The folder values and attempt that a key names."""
    parts = key.split("/")
    attempt = _ATTEMPT.search(parts[-1]) if len(parts) == 5 else None
    named = [p.partition("=") for p in parts[:4]]
    if attempt is None or [n[0] for n in named] != list(FOLDERS):
        return None
    return *[n[2] for n in named], int(attempt[1])


def _key(address: tuple) -> str:
    return "/".join(f"{n}={v}" for n, v in zip(FOLDERS, address)) + f"/attempt={address[4]}.log"


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        super().__init__(keys)


class LogReader(DataSourceReader):
    """Reads the logs that the pushed filters name; where they leave a key open, what lies below the folders they name."""

    def __init__(self, root: str):
        self.root, self.wanted = root, {}

    def pushFilters(self, filters):  # noqa: N802 - the name is Spark's
        for one in filters:
            name = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if name in KEYS and values is not None:
                self.wanted[name] = self.wanted.get(name, values) & values
            # Spark still checks every filter, so a looser reading is safe.
            yield one

    def partitions(self) -> list[_Keys]:
        known = list(itertools.takewhile(self.wanted.__contains__, KEYS))
        heads = itertools.product(*[sorted(self.wanted[n]) for n in known])
        if len(known) == len(KEYS):
            keys = [_key(h) for h in heads]
        else:
            store = Store(self.root)
            keys = [k for h in heads for k in store.below("/".join(f"{n}={v}" for n, v in zip(known, h))) if self._fits(k)]
        return [_Keys(keys[at : at + PER_PARTITION]) for at in range(0, len(keys), PER_PARTITION)]

    def _fits(self, key: str) -> bool:
        address = _address(key)
        return address is not None and all(address[KEYS.index(n)] in v for n, v in self.wanted.items())

    def read(self, partition: _Keys | None) -> Iterator[tuple]:
        store = Store(self.root)
        # Without any partition Spark still asks once.
        for key in partition.value if partition is not None else ():
            content = store.read(key)
            if content is not None:
                yield content.decode("utf-8", "replace"), *_address(key), store.uri(store.path(key))


class _Manifest(WriterCommitMessage):
    def __init__(self, key: str):
        self.key = key


class ObjectWriter(DataSourceWriter):
    """Writes (``key``, ``content``) rows as objects. A failed task or job takes the objects back that it made."""

    def __init__(self, root: str, changed_only: bool):
        self.root, self.changed_only = root, changed_only
        self.job = f"_writes/{uuid.uuid4().hex}"

    def write(self, iterator) -> _Manifest:
        store, made = Store(self.root), []
        try:
            for key, content in iterator:
                content = content.encode() if isinstance(content, str) else bytes(content or b"")
                if key is None or key.startswith("/") or ".." in key.split("/"):
                    raise ValueError(f"not a key below the root: {key!r}")
                if self.changed_only and store.holds(key, content):
                    continue
                if store.files.get_file_info(store.path(key)).type == fs.FileType.NotFound:
                    made.append(key)
                store.write(key, content)
            # The list of new objects stays in the store until the job is done.
            manifest = f"{self.job}/{uuid.uuid4().hex}.json"
            store.write(manifest, json.dumps(made).encode())
        except BaseException:
            for key in made:
                store.delete(key)
            raise
        return _Manifest(manifest)

    def _clear(self, store: Store) -> None:
        for key in store.below(self.job):
            store.delete(key)
        for folder in (self.job, "_writes"):
            if store.files.type_name in ("local", "hdfs") and not store.below(folder):
                store.files.delete_dir(store.path(folder))

    def commit(self, messages) -> None:
        self._clear(Store(self.root))

    def abort(self, messages) -> None:
        store = Store(self.root)
        for message in messages:
            if message is not None:
                for key in json.loads(store.read(message.key) or b"[]"):
                    store.delete(key)
        self._clear(store)


class LakeObjects(DataSource):
    """``format("lake_objects")``: read attempt logs by key, write objects at theirs."""

    @classmethod
    def name(cls) -> str:
        return "lake_objects"

    def schema(self) -> str:
        return LOGS

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are replaced one by one: use the mode append")
        return ObjectWriter(self.options["path"], self.options.get("changedonly", "false") == "true")


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """Attempt logs as in ``lake.scan_task_logs``, read by key: equality and ``isin`` filters on the folder values and
    the attempt decide which objects are opened, and without a gap between the folders nothing is listed."""
    spark.dataSource.register(LakeObjects)
    if spark.conf.get(_PUSH, "false") != "true":
        spark.conf.set(_PUSH, "true")
    return spark.read.format("lake_objects").load(root)


def write_objects(rows: DataFrame, root: str, changed_only: bool = False) -> None:
    """Write ``content`` (text or bytes) of every row at its ``key`` below ``root``.

    Objects that are there are replaced; with ``changed_only`` those with the same size and digest are left alone, as in
    a sync. Keys must differ. When a task or the job fails, objects that it made are removed again.
    """
    rows.sparkSession.dataSource.register(LakeObjects)
    options = {"path": root, "changedonly": str(changed_only).lower()}
    rows.select("key", "content").write.format("lake_objects").options(**options).mode("append").save()


def lookup_objects(requests: DataFrame, root: str) -> DataFrame:
    """Add ``log_text``, ``uri`` and ``log_found`` to each request (columns of ``KEYS``), as ``logs.lookup_logs`` does.

    The object at the exact key is opened; where it is absent, the folder of the task is listed and
    its newest log is taken. Only addresses and the texts asked for move.
    """
    schema = "_at struct<{}>, log_text string, uri string".format(
        ",".join(f"{n}:{'int' if n == 'attempt' else 'string'}" for n in KEYS)
    )

    def run(batches):
        store, newest = Store(root), {}
        for batch in batches:
            found = []
            for row in batch.column("_at").to_pylist():
                address = tuple(row[n] for n in KEYS)
                key = None if None in address else _key(address)
                text = None if key is None else store.read(key)
                if text is None and None not in address[:3]:
                    if address[:3] not in newest:
                        folder = "/".join(f"{n}={v}" for n, v in zip(FOLDERS, address[:3]))
                        own = [k for k in store.below(folder) if _address(k)]
                        newest[address[:3]] = max(own, key=lambda k: _address(k)[3:], default=None)
                    key = newest[address[:3]]
                    text = None if key is None else store.read(key)
                found.append((row, None if text is None else text.decode("utf-8", "replace"), None if text is None else store.uri(store.path(key))))
            kind = pa.struct([(n, pa.int32() if n == "attempt" else pa.string()) for n in KEYS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                names=["_at", "log_text", "uri"],
            )

    address = F.struct(*[F.col(n).cast("int" if n == "attempt" else "string").alias(n) for n in KEYS]).alias("_at")
    # Requests of one task meet, so its folder is listed once.
    wanted = requests.select(address).distinct().repartition("_at.cluster", "_at.dag_id", "_at.task_id")
    texts = wanted.mapInArrow(run, schema).where("uri IS NOT NULL").withColumnRenamed("_at", "_of")
    joined = requests.select("*", address).join(texts, F.col("_at").eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("log_found", F.col("uri").isNotNull()).drop("_at", "_of")
