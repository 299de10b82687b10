"""Stages that are computed once and kept as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import exists


class Stage:
    """A DataFrame kept at a path. Only a completed write counts: a half-written one is written anew."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> None:
        self.spark, self.path, self.build = spark, path, build

    def get(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/_SUCCESS"):
            self.build().write.mode("overwrite").parquet(self.path)
        return self.spark.read.parquet(self.path)
