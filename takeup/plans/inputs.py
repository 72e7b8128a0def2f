"""Stand-in tables of one data directory, staged once per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from takeup.operators.folds import multilabel_folds
from takeup.plans import standins as S
from takeup.session import importable_in_workers, new_path

_paths: dict[tuple[str, str, str], str] = {}


class Inputs:
    """Every table is derived by Spark from the given tables. The derived tables feed
    many queries, so each is written once to the shared folder and read back."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = importable_in_workers(spark), sf_dir.rstrip("/")

    def _staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        slot = (self.spark.sparkContext.applicationId, self.dir, name)
        if slot in _paths:
            try:
                return self.spark.read.parquet(_paths[slot])
            except AnalysisException:
                pass  # removed in between: build again
        path = new_path(self.spark, name)
        build().write.parquet(path)
        _paths[slot] = path
        return self.spark.read.parquet(path)

    def raw(self, name: str) -> DataFrame:
        return S.table(self.spark, self.dir, name)

    def main(self) -> DataFrame:
        return self._staged("main", lambda: S.main_table(self.spark, self.dir))

    def extra(self) -> DataFrame:
        return self._staged("extra", lambda: S.extra_table(self.spark, self.dir))

    def target(self) -> DataFrame:
        return self._staged("target", lambda: S.target_table(self.spark, self.dir))

    def folds(self) -> DataFrame:
        return self._staged("folds", lambda: multilabel_folds(S.train_keys(self.target()), S.TARGETS))

    def score(self) -> DataFrame:
        return self._staged("score", lambda: S.score_table(self.target()))

    def template(self) -> DataFrame:
        return S.template_table(self.spark, self.dir)

    def warm(self) -> None:
        for build in (self.main, self.extra, self.target, self.folds, self.score):
            build()

    # -- common combinations ---------------------------------------------------

    def train_targets(self) -> DataFrame:
        return S.train_keys(self.target())

    def main_with_folds(self) -> DataFrame:
        """All clients with labels for train rows only and a null fold for test rows."""
        labelled = self.folds().join(self.target(), "customer_id")
        return self.main().join(labelled, "customer_id", "left")

    def train_extra_targets(self) -> DataFrame:
        return self.extra().join(self.train_targets(), "customer_id")

    def all_scores(self) -> DataFrame:
        return self.score().selectExpr("*", f"{S.split_of('customer_id')} as split")

    def drop_split(self) -> DataFrame:
        return self.main().drop("split")


