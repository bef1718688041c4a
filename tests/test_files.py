"""Files of the format by the thousand: what the driver has to do with each, and what is written in stores that machines don't mount."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import consent
from tracemill.plans import adapters
from tracemill.sources import files, sinks


def _lines(spark, n: int, word: str = "v") -> DataFrame:
    k = F.col("id").cast("string")
    return spark.range(n).select(F.concat(F.lit("d/"), (F.col("id") % 7).cast("string"), F.lit("/f"), k, F.lit(".txt")).alias("path"), F.explode(F.array(F.lit(None).cast("string"), F.concat(F.lit(f"é{word}"), k))).alias("value"))


@pytest.fixture
def fetched(spark, monkeypatch):
    """Numbers of rows that calls brought to the driver."""
    kind, found = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (found.append(len(out := collect(self))), out)[1])
    return found


def test_the_driver_has_nothing_to_do_with_single_files(spark, sf_dir, tmp_path, fetched, monkeypatch):
    r = consent.with_ids(adapters.sample_records(spark, sf_dir)).withColumn("session_id", F.col("conv_id").cast("string")).drop("conv_id")
    assert sinks.write_staging(r, f"file://{tmp_path}/staging") == 20 and len(list((tmp_path / "staging").glob("session_*.json"))) == 20
    ids = r.select("record_id").distinct().count()
    assert sinks.write_outbox(r.drop("session_id"), f"file://{tmp_path}/out") == ids
    assert max(fetched) <= 1

    def listing(*_):
        raise AssertionError("a row for each file reached the driver")

    monkeypatch.setattr(files, "listing", listing)
    for ordered in (True, False):
        assert files.outbox(spark, f"file://{tmp_path}/out", ordered=ordered).count() == ids
        assert files.staging(spark, f"file://{tmp_path}/staging", ordered=ordered).count() == 20
    assert files.outbox(spark, f"file://{tmp_path}/nothing").count() == 0


def test_files_are_replaced_whole_with_what_hadoop_left_beside_them(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    sinks.write_text(spark, f"{root}/d/0/f0.txt", "written through Hadoop, with a checksum beside it")
    for word in ("v", "w"):
        assert sinks.write_files(_lines(spark, 300, word), root, [F.col("value")]) == 300
        assert {p.name: p.read_text() for p in tmp_path.rglob("f*.txt")} == {f"f{i}.txt": f"\né{word}{i}\n" for i in range(300)}
    assert spark.read.text(f"{root}/d/0/f0.txt").count() == 2
    assert not list((tmp_path / "root").glob("_incoming*"))
    assert sinks.write_files(_lines(spark, 0), root, [F.col("value")]) == 0


def test_files_in_a_store_that_only_hadoop_reaches(spark, tmp_path):
    (tmp_path / "store").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.written.link./in", f"file://{tmp_path}/store")
    root = "viewfs://written/in/root"
    assert sinks._mounted(spark, root) is None
    for word in ("v", "w"):
        assert sinks.write_files(_lines(spark, 40, word), root, [F.col("value")]) == 40
        assert {p.name: p.read_text() for p in tmp_path.rglob("f*.txt")} == {f"f{i}.txt": f"\né{word}{i}\n" for i in range(40)}
    assert files.lines_in(spark, f"{root}/d/0", "*.txt").count() > 0 and not list((tmp_path / "store/root").glob("_incoming*"))
