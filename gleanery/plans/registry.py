"""Registration of named queries next to their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

#: Rows handed to Python at a time: whole texts are long.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Tables:
    """Lazy access to the parquet tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run derivation SQL whose ``{table}`` marks name the parquet tables."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        text = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            text = text.replace("{{" + t + "}}", "{" + t + "}")
        return self.spark.sql(text, **used)


def plain(text: str) -> str:
    """The same SQL over the views of the checking engine."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


class Catalog:
    def __init__(self) -> None:
        self.runs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.checks: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn: Callable[[Tables], DataFrame]):
            if name in self.runs:
                raise ValueError(f"query registered twice: {name}")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                if not 0 < int(spark.conf.get(ARROW_ROWS)) <= 1000:
                    spark.conf.set(ARROW_ROWS, "1000")
                return fn(Tables(spark, sf_dir))
            self.runs[name] = run
            if sql is not None:
                self.checks[name] = plain(sql)
            return fn
        return add
