"""Writers and the official factor store."""

from __future__ import annotations

import json
from datetime import date, datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["trade_date", "ts_code"]
VALUES = "factor_id string, trade_date date, ts_code string, factor_value double"
REGISTRY = "factor_id string, manifest string, status string, watermark date, recorded timestamp"


class StoreError(ValueError):
    """A write that the store's contract forbids."""


def write_partitioned(df: DataFrame, root: str, by: list[str], sort: list[str], mode: str = "append") -> None:
    """Parquet by partition, each written by one task and sorted; the committer makes the job's files appear at once."""
    df.repartition(*by).sortWithinPartitions(*by, *sort).write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def check_values(df: DataFrame) -> DataFrame:
    """Fail unless keys are unique and complete and values finite: one aggregation."""
    bad = df.agg(
        F.count_if(F.col("factor_value").isNull() | F.isnan("factor_value") | (F.abs("factor_value") == float("inf"))).alias("not_finite"),
        F.count_if(F.col("trade_date").isNull() | F.col("ts_code").isNull()).alias("no_key"),
    ).first()
    twice = df.groupBy(*KEY).count().where("count > 1").limit(1).count()
    if bad["not_finite"] or bad["no_key"] or twice:
        raise StoreError(f"{bad['not_finite']} values aren't finite, {bad['no_key']} rows lack a key, keys repeat: {bool(twice)}")
    return df


class FactorStore:
    """Factors by (factor_id, trade_date): register, import history, activate, write days, read.

    Values are Parquet partitions, so a day's rewrite replaces that day only. The registry is a small table of events;
    a factor's state is its last one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(PurePosixPath(root)) if ":" not in root else root.rstrip("/")

    def _values(self) -> DataFrame:
        from quillstone.sources.readers import lake

        return lake(self.spark, f"{self.root}/values", VALUES)

    def registry(self) -> DataFrame:
        """The last event of each factor."""
        from quillstone.sources.readers import lake

        events = lake(self.spark, f"{self.root}/registry", REGISTRY)
        return events.groupBy("factor_id").agg(*(F.max_by(c, "recorded").alias(c) for c in ("manifest", "status", "watermark")))

    def _state(self, factor: str) -> dict | None:
        row = self.registry().where(F.col("factor_id") == factor).first()
        return row.asDict() if row else None

    def _record(self, factor: str, manifest: str, status: str, watermark: date | None) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(factor, manifest, status, watermark, now)], REGISTRY).coalesce(1).write.mode("append").parquet(f"{self.root}/registry")

    def register(self, factor: str, manifest: dict) -> None:
        """Twice with one manifest is fine; with another it is refused."""
        text = json.dumps(manifest, sort_keys=True)
        if state := self._state(factor):
            if state["manifest"] != text:
                raise StoreError(f"{factor} is registered with another manifest")
            return
        self._record(factor, text, "registered", None)

    def import_history(self, factor: str, df: DataFrame) -> None:
        """Values before activation; dates that the store has already are refused."""
        state = self._need(factor, "registered")
        df = check_values(df.select(*KEY, "factor_value"))
        days = self._values().where(F.col("factor_id") == factor).select("trade_date").distinct()
        if df.join(days, "trade_date", "left_semi").limit(1).count():
            raise StoreError(f"{factor}: the history overlaps what is stored")
        self._write(factor, df)
        self._record(factor, state["manifest"], "registered", df.agg(F.max("trade_date")).first()[0])

    def activate(self, factor: str) -> None:
        state = self._need(factor, "registered")
        if state["watermark"] is None:
            raise StoreError(f"{factor} has no history")
        self._record(factor, state["manifest"], "active", state["watermark"])

    def write_day(self, factor: str, day: date, df: DataFrame) -> None:
        """Replace one day of an active factor."""
        state = self._need(factor, "active")
        df = check_values(df.select(*KEY, "factor_value"))
        if df.where(F.col("trade_date") != F.lit(day)).limit(1).count():
            raise StoreError(f"{factor}: rows of other days than {day}")
        self._write(factor, df)
        self._record(factor, state["manifest"], "active", max(day, state["watermark"]))

    def _need(self, factor: str, status: str) -> dict:
        state = self._state(factor)
        if not state or state["status"] != status:
            raise StoreError(f"{factor} isn't {status}")
        return state

    def _write(self, factor: str, df: DataFrame) -> None:
        write_partitioned(df.withColumn("factor_id", F.lit(factor)), f"{self.root}/values", ["factor_id", "trade_date"], ["ts_code"], "overwrite")

    def read(self, factors: list[str], first: date | None = None, last: date | None = None) -> DataFrame:
        """Values of factors between two dates; both filters prune partitions."""
        v = self._values().where(F.col("factor_id").isin(factors))
        v = v if first is None else v.where(F.col("trade_date") >= F.lit(first))
        return v if last is None else v.where(F.col("trade_date") <= F.lit(last))

    def pending(self, factor: str, days: DataFrame) -> DataFrame:
        """Days that the store lacks for a factor: what a resumed run has to do."""
        done = self._values().where(F.col("factor_id") == factor).select("trade_date").distinct()
        return days.select("trade_date").distinct().join(done, "trade_date", "left_anti")


def ingest_snapshot(spark: SparkSession, manifest_root: str, snapshot: str, digest: str) -> bool:
    """Whether a snapshot is new: the same content again is fine and skipped, other content under its name is refused."""
    from quillstone.sources.readers import lake

    seen = lake(spark, manifest_root, "snapshot string, digest string").where(F.col("snapshot") == snapshot).select("digest").distinct().collect()
    if any(x["digest"] != digest for x in seen):
        raise StoreError(f"snapshot {snapshot} has changed")
    if not seen:
        spark.createDataFrame([(snapshot, digest)], "snapshot string, digest string").coalesce(1).write.mode("append").parquet(manifest_root)
    return not seen
