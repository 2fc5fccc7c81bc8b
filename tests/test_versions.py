from concurrent.futures import ThreadPoolExecutor
from datetime import date
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from quillstone.sources import versions
from quillstone.sources.store import StoreError
from shown import rows

SCHEMA = "trade_date date, ts_code string, a double, b double"


@pytest.fixture
def table(spark, tmp_path):
    return versions.DayTable(spark, str(tmp_path / "t"))


def frame(spark, *days, codes="CAB", value=1.0):
    return spark.createDataFrame([(date(2026, 1, d), c, value * d, None) for d in days for c in codes], SCHEMA)


def days(table, **more):
    return sorted({x[0].day for x in table.read(**more).select("trade_date").collect()})


def test_days_are_skipped_replaced_or_refused_and_rolled_back(spark, table):
    with pytest.raises(StoreError):
        table.read()
    assert table.version() == 0 and table.install(frame(spark)).version == 0
    first = table.install(frame(spark, 1, 2))
    assert (first.version, first.installed, first.skipped) == (1, ["2026-01-01", "2026-01-02"], []) and first.checks["rows"] == 6
    second = table.install(frame(spark, 2, 3, value=10.0))
    assert (second.installed, second.skipped) == (["2026-01-03"], ["2026-01-02"]) and second.checks["rows"] == 3
    with pytest.raises(StoreError, match="2026-01-02"):
        table.install(frame(spark, 2, 5), "fail")
    assert table.install(frame(spark, 1, 2)).version == 2  # nothing new, no version
    table.install(frame(spark, 2, value=100.0), "replace")
    value = lambda **more: {x[0].day: x[1] for x in table.read(**more).select("trade_date", "a").collect()}
    assert value() == {1: 1.0, 2: 200.0, 3: 30.0} and value(version=2) == {1: 1.0, 2: 2.0, 3: 30.0}
    assert table.backups("2026-01-02") == [f"data/{table.history()[0]['run']}/_day=2026-01-02"]
    assert days(table, first=date(2026, 1, 2), last=date(2026, 1, 2)) == [2]
    assert table.rollback(1) == 4 and value() == {1: 1.0, 2: 2.0} and [x["action"] for x in table.history()] == ["skip", "skip", "replace", "rollback to 1"]
    assert rows(table.read(), "ts_code") == [("A",)] * 2 + [("B",)] * 2 + [("C",)] * 2
    with pytest.raises(StoreError):
        table.rollback(9)


def test_one_sorted_wide_file_a_day(spark, table):
    table.install(frame(spark, 1, 2, codes="QZAMB").repartition(7))
    files = table.read().inputFiles()
    assert len(files) == 2
    for f in files:
        assert [x.ts_code for x in spark.read.parquet(f).collect()] == list("ABMQZ")


@pytest.mark.parametrize(("bad", "what"), [((date(2026, 1, 2), None, 1.0, 1.0), "code"), ((date(2026, 1, 2), "Z", float("nan"), 1.0), "finite"), ((date(2026, 1, 2), "Z", 1.0, float("-inf")), "finite"), ((date(2026, 1, 2), "A", 5.0, 5.0), "once"), ((None, "Z", 1.0, 1.0), "date")])
def test_a_failed_check_leaves_the_old_version(spark, table, tmp_path, bad, what):
    table.install(frame(spark, 2))
    with pytest.raises(versions.ChecksFailed, match=f"{what}: 1 rows"):
        table.install(frame(spark, 2, 3).unionByName(spark.createDataFrame([bad], SCHEMA)), "replace")
    assert table.version() == 1 and days(table) == [2] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_own_checks_and_warnings_are_counted_by_the_write(spark, table):
    done = table.install(frame(spark, 1, 2, 3), errors={"small": F.col("a") < 9}, warnings={"b_there": F.col("b").isNotNull(), "first": F.col("a") == 1})
    assert done.version == 1 and {k: done.checks[k] for k in ("rows", "small", "b_there", "first", "once", "date")} == {"rows": 9, "small": 0, "b_there": 9, "first": 6, "once": 0, "date": 0}
    with pytest.raises(versions.ChecksFailed, match="small: 3 rows"):
        table.install(frame(spark, 4, 9), errors={"small": F.col("a") < 9})


def test_two_writers_cant_both_win(spark, table):
    table.install(frame(spark, 1))
    gate = Barrier(2)

    class Slow(versions.DayTable):
        def _commit(self, version, entry):
            gate.wait(60)
            super()._commit(version, entry)

    def write(d):
        try:
            return Slow(spark, table.root).install(frame(spark, d)).version
        except versions.Outrun:
            return "outrun"

    with ThreadPoolExecutor(2) as pool:
        assert sorted(map(str, pool.map(write, (2, 3)))) == ["2", "outrun"]
    assert len(days(table)) == 2 and table.version() == 2


def test_the_log_also_works_by_hadoop(spark, tmp_path):
    class Far(versions.DayTable):
        def _commit(self, version, entry):
            self.root, root = self.root.replace("file:", "FILE:"), self.root  # another scheme than the local one to the code
            try:
                super()._commit(version, entry)
            finally:
                self.root = root

    t = Far(spark, f"file:{tmp_path}/far")
    try:
        t.install(frame(spark, 1))
    except Exception as e:  # where Hadoop knows no such scheme there is nothing to test
        pytest.skip(str(e)[:80])
    assert days(t) == [1]
