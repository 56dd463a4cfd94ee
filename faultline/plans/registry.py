"""Registration of whole queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import derived

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Base tables and derived relations of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        # Runs once per name: the plan is kept as an attribute.
        if name in BASE_TABLES:
            table = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        elif name in derived.DERIVED:
            text = derived.spark_text(name)
            inputs = {n: getattr(self, n) for n in derived.names_in(text)}
            table = self.spark.sql(text, **inputs)
        else:
            raise AttributeError(name)
        self.__dict__[name] = table
        return table


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL check."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, root))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            _CHECKS[name] = check
        return fn

    return register


def checks() -> dict[str, str]:
    """Every SQL counterpart as one whole statement."""
    return {name: derived.check_text(body) for name, body in _CHECKS.items()}
