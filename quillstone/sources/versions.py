"""Tables of days in versions: installed whole or not at all, checked while they are written, and rolled back by a log.

A table is a folder with `data/<run>/_day=YYYY-MM-DD/` and `log/`. Nothing under data is ever changed: an install writes
new folders, takes its checks in the same pass, and then adds one entry to the log, which is what makes its days the
current ones. The entry's name is the next number and it appears by an operation that fails where that exists, so of two
writers that started from one version only one can win. The days that an entry replaces stay where they are, as a backup.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from datetime import date
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.store import StoreError


class ChecksFailed(StoreError):
    """Rows that were written violate a check; the version before is still the current one."""


class Outrun(StoreError):
    """Another writer has installed a version since this one started."""


@dataclass(frozen=True)
class Installed:
    """The version, days that were installed, days that were there and were skipped, and the counts of all checks."""

    version: int
    installed: list[str]
    skipped: list[str]
    checks: dict[str, int]


def key_and_values(names: list[str]) -> dict[str, Column]:
    """What a wide file of a day must hold: a code in every row, and values that are null or finite. {check: condition}"""
    finite = F.lit(True)
    for c in names:
        finite = finite & (F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf"))))
    return {"code": F.col("ts_code").isNotNull(), "finite": finite}


class DayTable:
    """Rows with trade_date and ts_code, one file a day, in order of the codes, no code twice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the log

    def _path(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[int]:
        there, fs = self._path(f"{self.root}/log")
        names = [x.getPath().getName() for x in fs.listStatus(there)] if fs.exists(there) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/log/{version:010d}.json", wholetext=True).first()[0])

    def version(self) -> int:
        """The current version; 0 before the first install."""
        return max(self._entries(), default=0)

    def days(self, version: int | None = None) -> dict[str, str]:
        """{day: folder} of a version. A log entry holds them all: a calendar's length, whatever the rows are."""
        v = self.version() if version is None else version
        return self._entry(v)["days"] if v else {}

    def history(self) -> list[dict]:
        """What each version was: version, run, action, installed, checks."""
        return [{k: v for k, v in self._entry(x).items() if k != "days"} | {"version": x} for x in self._entries()]

    def _commit(self, version: int, entry: dict) -> None:
        """Add the entry, or raise Outrun where that number is taken. Atomic on local (a link) and on HDFS (a rename that doesn't replace)."""
        final, raw = f"{self.root}/log/{version:010d}.json", json.dumps(entry, sort_keys=True).encode()
        url = urlparse(self.root)
        if url.scheme in ("", "file"):
            folder = f"{url.path}/log"
            os.makedirs(folder, exist_ok=True)
            temporary = f"{folder}/.{uuid.uuid4().hex}"
            with open(temporary, "xb") as f:
                f.write(raw)
            try:
                os.link(temporary, f"{folder}/{version:010d}.json")
            except FileExistsError:
                raise Outrun(f"version {version} exists already") from None
            finally:
                os.unlink(temporary)
            return
        jvm = self.spark._jvm
        temporary, fs = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(raw)
        out.close()
        there, _ = self._path(final)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.spark._jsc.hadoopConfiguration())
        if fs.exists(there):
            fs.delete(temporary, False)
            raise Outrun(f"version {version} exists already")
        context.rename(temporary, there, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    # -- writing

    def install(self, df: DataFrame, exists: str = "skip", errors: dict[str, Column] | None = None, warnings: dict[str, Column] | None = None, run: str | None = None) -> Installed:
        """Install the days of df. Days that the table has: "skip" them, "replace" them (the old ones stay as a backup), or "fail".

        errors and warnings are conditions that each row meets (null doesn't), counted by the pass that writes, as are
        codes that come twice in a day ("once"), null dates ("date") and, with the default errors, null codes and values
        that are neither null nor finite. If an error has violations the written files go and ChecksFailed is raised.
        A df without (new) rows installs nothing and makes no version. One shuffle by day; a task holds one day.
        """
        if exists not in ("skip", "replace", "fail"):
            raise ValueError(exists)
        base = self.version()
        now, run = self.days(base), run or uuid.uuid4().hex
        values = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        errors = {**(key_and_values(values) if errors is None else errors), "date": F.col("trade_date").isNotNull()}
        here = df.withColumn("_day", F.date_format("trade_date", "yyyy-MM-dd"))
        skipped: list[str] = []
        if now and exists != "replace":
            old = here.select("_day").distinct().where(F.col("_day").isin(list(now)))
            skipped = sorted(x[0] for x in old.collect())
            if skipped and exists == "fail":
                raise StoreError(f"the table has {', '.join(skipped[:5])} already")
            here = here.where(F.col("_day").isNull() | ~F.col("_day").isin(skipped)) if skipped else here
        folder, seen = f"{self.root}/data/{run}", Observation(f"checks-{run}")
        day = Window.partitionBy("_day").orderBy("ts_code")
        sorted_ = here.repartition("_day").withColumn("_twice", F.lag("ts_code").over(day).eqNullSafe(F.col("ts_code")) & F.col("ts_code").isNotNull())
        bad = {**errors, **(warnings or {}), "once": ~F.col("_twice")}
        counted = sorted_.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in bad.items()))
        counted.drop("_twice").write.mode("error").partitionBy("_day").option("compression", "zstd").parquet(folder)
        checks = dict(seen.get)
        there, fs = self._path(folder)
        failed = [k for k in (*errors, "once") if checks.get(k)]
        if failed or not checks.get("rows"):
            fs.delete(there, True)
            if failed:
                raise ChecksFailed(", ".join(f"{k}: {checks[k]} rows" for k in failed))
            return Installed(base, [], skipped, checks)
        fresh = sorted(x.getPath().getName()[len("_day=") :] for x in fs.listStatus(there) if x.getPath().getName().startswith("_day="))
        days = now | {x: f"data/{run}/_day={x}" for x in fresh}
        try:
            self._commit(base + 1, {"run": run, "action": exists, "installed": fresh, "checks": checks, "days": days})
        except Outrun:
            fs.delete(there, True)
            raise
        return Installed(base + 1, fresh, skipped, checks)

    def rollback(self, version: int) -> int:
        """Make an earlier version's days the current ones again, as a new version; returns its number."""
        now = self.version()
        if version not in (0, *self._entries()):
            raise StoreError(f"no version {version}")
        self._commit(now + 1, {"run": None, "action": f"rollback to {version}", "installed": [], "checks": {}, "days": self.days(version)})
        return now + 1

    # -- reading

    def read(self, first: date | None = None, last: date | None = None, version: int | None = None) -> DataFrame:
        """Rows of the days between two dates: the log tells which folders, so others aren't listed. StoreError where the table has no such day."""
        days = self.days(version)
        chosen = [f"{self.root}/{folder}" for day, folder in sorted(days.items()) if (first is None or day >= first.isoformat()) and (last is None or day <= last.isoformat())]
        if not chosen:
            raise StoreError("the table has no such day")
        return self.spark.read.parquet(*chosen)

    def backups(self, day: str) -> list[str]:
        """Folders that held the day before, oldest first."""
        out: list[str] = []
        for x in self._entries():
            there = self._entry(x)["days"].get(day)
            if there and there not in out:
                out.append(there)
        return [x for x in out if x != self.days().get(day)]
