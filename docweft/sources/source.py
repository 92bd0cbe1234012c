"""A named, read-only source: any DataFrame, with the readers Spark already has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    df: DataFrame
    name: str = "source"
    schema: tuple[str, ...] | None = None

    @staticmethod
    def parquet(spark: SparkSession, path: str, name: str | None = None) -> Source:
        return Source(spark.read.parquet(path), name or path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet"))

    @staticmethod
    def json(spark: SparkSession, path: str, schema, name: str | None = None) -> Source:
        """``schema`` is asked for: inferring it would read everything twice."""
        return Source(spark.read.schema(schema).json(path), name or path.rstrip("/").rsplit("/", 1)[-1])

    @staticmethod
    def table(spark: SparkSession, name: str) -> Source:
        return Source(spark.table(name), name)

    def __repr__(self) -> str:
        return f"<Source {self.name}: {', '.join(self.schema or self.df.columns)}>"
