"""Results addressed by what they were made of: computed once, published whole, reused, and batches that go on where they stopped."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import evaluate


def contents(df: DataFrame) -> dict[str, object]:
    """A digest of a table's rows, whatever their order and files: schema, number of rows, and the sum of the rows' 64-bit hashes under two seeds. One scan, one row to the driver.

    Rows that repeat count as often as they do; a null differs from any value.
    """
    cols = [F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in sorted(df.columns)))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in (1, 2)]
    row = df.agg(F.count("*").alias("n"), *(x.alias(f"s{k}") for k, x in enumerate(sums))).first()
    return {"schema": sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields), "rows": row["n"], "sums": [str(row["s0"]), str(row["s1"])]}


class Results:
    """A folder of results by digest. A folder named by its digest is whole: it is written elsewhere and then renamed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, settings: dict, **inputs: DataFrame) -> str:
        """The digest of settings and of the inputs' contents: a changed row, value, column or setting gives another."""
        about = {"settings": settings, "inputs": {k: contents(v) for k, v in sorted(inputs.items())}}
        return hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, key: str) -> bool:
        there, fs = self._fs(f"{self.root}/{key}")
        return fs.exists(there)

    def publish(self, key: str, df: DataFrame) -> None:
        """Write df under the key, unless another writer has done so meanwhile: then its result stays and this one goes."""
        staged, fs = self._fs(f"{self.root}/_staging/{uuid.uuid4().hex}")
        df.write.parquet(staged.toString())
        final, _ = self._fs(f"{self.root}/{key}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, True)

    def get(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The result of that key; where there is none, build() is called, and what it gives is published first."""
        if not self.has(key):
            self.publish(key, build())
        return self.spark.read.parquet(f"{self.root}/{key}")


class Batches:
    """Information coefficients of many factors, in batches that are published one by one.

    values: factor_id, trade_date, ts_code, value; labels: trade_date, ts_code, label. A run is addressed by the labels'
    contents and the settings; done are the (factor, session) pairs that it has, so an interrupted run goes on with what
    lacks, and later sessions or factors are added to it. Values that change under a pair that is done aren't looked at:
    rename the factor, or begin anew with another setting.
    """

    def __init__(self, results: Results, labels: DataFrame, settings: dict):
        self.results, self.labels, self.run = results, labels, "run-" + results.key({"batches": settings}, labels=labels)

    def done(self) -> DataFrame | None:
        """All rows of the published batches; None before the first."""
        there, fs = self.results._fs(f"{self.results.root}/{self.run}")
        try:
            return self.results.spark.read.option("recursiveFileLookup", True).parquet(there.toString()) if fs.exists(there) else None
        except AnalysisException as e:  # batches without any row
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return None

    def pending(self, values: DataFrame) -> DataFrame:
        """The values whose (factor, session) isn't done: what an interrupted run still has to do."""
        done = self.done()
        return values if done is None else values.join(done.select("factor_id", "trade_date"), ["factor_id", "trade_date"], "left_anti")

    def advance(self, values: DataFrame, size: int = 16, most: int | None = None) -> int:
        """Evaluate pending factors, `size` of them a batch and `most` batches at most; returns the batches published. A batch is done whole or not at all."""
        pending = self.pending(values)
        factors = [x[0] for x in pending.select("factor_id").distinct().orderBy("factor_id").collect()]
        batches = [factors[i : i + size] for i in range(0, len(factors), size)][:most]
        for some in batches:
            pairs = pending.where(F.col("factor_id").isin(some)).join(self.labels, ["trade_date", "ts_code"], "left")
            ics = evaluate.information_coefficients(pairs, "value", "label", ["factor_id", "trade_date"])
            every = pairs.select("factor_id", "trade_date").distinct().join(ics, ["factor_id", "trade_date"], "left")
            self.results.publish(f"{self.run}/{uuid.uuid4().hex}", every.withColumn("n", F.coalesce("n", F.lit(0))))
        return len(batches)
