"""Datasets with a log of commits, typed reading, tombstones, activity, and pruned scans of the format's layout."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import catalog, dataset
from tracemill.operators.validate import validate
from tracemill.plans import adapters
from tracemill.sources import consumed, files, sinks, typed
from tracemill.sources.records import record_ddl
from tracemill.sources.store import Conflict, Store


@pytest.fixture
def records(spark, sf_dir):
    return adapters.dataset(spark, sf_dir).drop("at").where("doc_id < 60").persist()


@pytest.fixture
def store(spark, records, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", records.schema, ("lang",))


def keys(df):
    return sorted((r.model_slug, r.tier, r.record_id, r.doc_id) for r in df.collect())


def files_of(df):
    return sorted(f.replace("file:///", "file:/") for f in df.inputFiles())


def test_two_publishes_give_what_one_insert_gives(store, records):
    even = records.where("doc_id % 2 = 0")
    want = dataset.insert_if_absent(even, records.where("false"), "doc_id")
    assert store.publish(even, "doc_id") == want.count() == store.scan().count()
    more = dataset.insert_if_absent(records, want, "doc_id")
    assert store.publish(records, "doc_id") == more.count()
    assert keys(store.scan()) == keys(want.unionByName(more)) and store.publish(records, "doc_id") == 0
    assert keys(store.scan(version=1)) == keys(want) and store.version() == 2


def test_a_scan_lists_only_the_files_of_its_model_and_tier(store, records):
    store.publish(records, "doc_id")
    model, tier = records.select("model_slug", "tier").first()
    for m, t in ((model, None), (model, tier), (None, tier)):
        live = store.live().where(F.lit(m is None) | (F.col("model_slug") == F.lit(m))).where(F.lit(t is None) | (F.col("tier") == F.lit(t)))
        own = store.scan(m, t)
        assert files_of(own) == sorted(r.path for r in live.collect()) and 0 < len(files_of(own)) < store.live().count()
        assert own.where((F.col("model_slug") != F.lit(m)) | (F.col("tier") != F.lit(t))).isEmpty()
    assert store.scan("no such model").count() == 0


def test_a_publish_reads_only_touched_shards(store, records, monkeypatch):
    store.publish(records, "doc_id")
    read = []
    own = Store._read
    monkeypatch.setattr(Store, "_read", lambda self, entries, columns=None: read.append(entries.count()) or own(self, entries, columns))
    one = records.limit(1).withColumn("record_id", F.lit("record_new")).withColumn("shard", records.first().shard and F.lit(records.first().shard))
    assert store.publish(one, "doc_id") == 1 and read == [1]


def test_the_log_s_catalog_is_that_of_a_rebuild(store, records):
    for part in (records.where("doc_id % 3 = 0"), records.where("doc_id % 3 = 1"), records):
        store.publish(part.withColumn("model_name", F.when(F.col("doc_id") % 4 == 0, F.upper("model_name")).otherwise(F.col("model_name"))), "doc_id")
    rows = store.scan()
    assert sorted(map(tuple, store.tiers().select("model_slug", "tier", "record_count", "avg_quality_score", "shards").collect())) == sorted(map(tuple, catalog.tier_stats(rows).collect()))
    version = store.live().select("version", F.explode(F.array("path")).alias("path"))
    at = rows.withColumn("path", F.col("_metadata.file_path")).join(version, "path").withColumn("at", F.struct("tier", "shard", "version", "doc_id"))
    want = {r.model_slug: r.asDict(recursive=True) for r in catalog.model_stats(at, ("lang",)).collect()}
    got = {r.model_slug: r.asDict(recursive=True) for r in store.models().collect()}
    empty = lambda x: x | {"hardware_distribution": x["hardware_distribution"] or {}}
    assert {k: empty(v) for k, v in got.items()} == {k: empty(v) for k, v in want.items()}
    assert store.tiers().agg(F.sum("total_size_bytes")).first()[0] > 0


@pytest.mark.parametrize("step", ["_stage", "commit"])
def test_a_publish_that_dies_leaves_the_old_state(store, records, monkeypatch, step):
    store.publish(records.where("doc_id % 2 = 0"), "doc_id")
    before = keys(store.scan()), sorted(map(tuple, store.tiers().drop("last_updated").collect()))
    own = getattr(Store, step)

    def dies(self, *args):
        if step == "_stage":
            own(self, *args)  # files are written, the entry isn't
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, step, dies)
    with pytest.raises(KeyboardInterrupt):
        store.publish(records, "doc_id")
    monkeypatch.undo()
    assert (keys(store.scan()), sorted(map(tuple, store.tiers().drop("last_updated").collect()))) == before
    assert store.publish(records, "doc_id") > 0


def test_writers_at_once_lose_nothing(store, records, monkeypatch):
    """Another writer commits while one is staging: the entry isn't overwritten, and what is new is worked out again."""
    other, own, left = Store(store.spark, store.root, store.columns, ("lang",)), Store._stage, [1]

    def staged(self, rows, version, order):
        out = own(self, rows, version, order)
        if self is store and left:
            left.pop()
            other.publish(records.where("doc_id % 2 = 0"), "doc_id")
        return out

    monkeypatch.setattr(Store, "_stage", staged)
    store.publish(records, "doc_id")
    got = keys(store.scan())
    assert store.version() == 2 and len(got) == len(set(x[:3] for x in got)) == dataset.first_of_each(records, "doc_id").count()
    with pytest.raises(Conflict):
        store.commit(2, ["{}"])
    assert keys(store.scan()) == got


def test_tombstones(store, records, spark):
    store.publish(records, "doc_id")
    ids = [r.record_id for r in records.select("record_id").distinct().limit(5).collect()]
    row = lambda *x: spark.createDataFrame([(i, "now", None) for i in x], "record_id string, deleted_at string, reason string")
    assert [store.delete(row(ids[0])), store.delete(row(ids[1], ids[1])), store.delete(row("no such record"))] == [1, 2, 1]
    want = keys(store.scan().where(~F.col("record_id").isin(*ids[:2])))
    assert keys(store.active()) == want and store.deletions_count() == 4
    store.compact_tombstones()
    assert keys(store.active()) == want and store.deletions_count() == 4 and store.live("tombstones").count() < 3
    assert keys(store.scan(version=1)) == keys(store.scan())


def test_deletions_are_appended_beside_the_file(spark, tmp_path):
    file = f"file://{tmp_path}/deletions.jsonl"
    assert files.count_lines(spark, file) == 0
    row = lambda i: spark.createDataFrame([(i, "t", None)], "record_id string, deleted_at string, reason string")
    sinks.append_deletions(row("a"), file)
    (tmp_path / "deletions.jsonl").write_text('{"record_id": "b", "deleted_at": "t", "reason": null}\n')
    sinks.append_deletions(row("c"), file)
    assert files.count_lines(spark, file) == 3 and {r.record_id for r in files.deletions(spark, file).collect()} == {"a", "b", "c"}


def test_numbers_are_read_as_the_format_s_validator_does(spark):
    turn = {"from": "human", "value": "v", "token_count": "7"}
    record = lambda n, **more: json.dumps({"record_id": str(n), "trajectory": {"conversations": [turn], "turn_count": n}} | more)
    lines = [record("1"), record(1.0), record(" +1.00 "), record("x"), record(1.5), record(None), record(1, quality={"quality_tier": "gold", "composite_score": "0.5", "sub_scores": {"a": "z"}}), record(1, model={"model_name": "m", "is_local": "yes"}), "[1]", "no"]
    df = typed.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), record_ddl())
    rows = df.collect()
    assert [r.r and r.r.trajectory.turn_count for r in rows] == [1, 1, 1, None, None, None, 1, 1, None, None]
    assert [[(u.field, u.raw) for u in r.unread or []] for r in rows] == [[], [], [], [("trajectory.turn_count", "x")], [("trajectory.turn_count", "1.5")], [], [("quality.sub_scores", "z")], [], [], []]
    assert rows[0].r.trajectory.conversations[0].token_count == 7 and rows[6].r.quality.composite_score == 0.5 and rows[7].r.model.is_local
    good, bad = validate(df.where("r is not null").select("r.*", "unread"))
    assert [r.errors for r in bad.collect()] == [["type:trajectory.turn_count"], ["type:trajectory.turn_count"], ["type:quality.sub_scores"]] and good.count() == 5


def test_readers_say_what_they_could_not_read(spark, tmp_path):
    shard = tmp_path / "data/m/gold"
    shard.mkdir(parents=True)
    other = tmp_path / "data/n/silver"
    other.mkdir(parents=True)
    (shard / "shard_00.jsonl").write_text('{"record_id": "a", "outcome": {"user_rating": "5"}}\n{"record_id": "b", "outcome": {"user_rating": "five"}}\n')
    (other / "shard_00.jsonl").write_text('{"record_id": "c"}\n')
    root = f"file://{tmp_path}"
    rows = {r.record_id: r for r in files.shards(spark, root, unread=True).collect()}
    assert rows["a"].outcome.user_rating == 5 and [u.raw for u in rows["b"].unread] == ["five"] and rows["c"].unread == []
    for model, tier, found in (("m", None, {"a", "b"}), (None, "silver", {"c"}), ("m", "silver", set())):
        df = files.shards(spark, root, model, tier)
        assert {r.record_id for r in df.collect()} == found and len(df.inputFiles()) == (1 if found else 0)
    with pytest.raises(ValueError, match="no folder"):
        files.shards(spark, root, "../m")


def test_activity_is_consumed_once(spark, tmp_path):
    folder, state = tmp_path / "activity", f"file://{tmp_path}/state"
    folder.mkdir()
    line = lambda action: json.dumps({"action": action, "record_id": "r", "quality_tier": "gold", "timestamp": "t"}) + "\n"
    counted = lambda: {r.action: r.n for r in consumed.consume_activity(spark, f"file://{folder}", state).collect()}
    assert counted() == {}
    (folder / "1.json").write_text(line("submitted") * 3 + line("queued"))
    assert counted() == {"submitted": 3, "queued": 1} and counted() == {}
    (folder / "2.json").write_text(line("submitted"))
    (folder / "3.json").write_text(line("queued") + "{broken\n")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises for a bad line
        counted()
    (folder / "3.json").write_text(line("queued"))
    assert counted() == {"submitted": 1, "queued": 1} and counted() == {}


def test_a_file_is_replaced_by_one_rename(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("x/y.txt", v)], "path string, value string")
    for v in ("one", "two"):
        assert sinks.write_files(rows(v), f"file://{tmp_path}/root", [F.lit(0)]) == 1
        assert (tmp_path / "root/x/y.txt").read_text() == f"{v}\n"
    assert not list((tmp_path / "root").glob("_incoming*"))
