"""Stored collections: whole replacement, dropped ones, streams and open merges."""

import pytest
from pyspark.sql import functions as F

from lattica import api
from lattica.sources import files
from lattica.sources.store import Store
from lattica.sources.versioning import Repository, VersionError
from lattica.streaming.cdc import apply_events, apply_stream, compact, follow, initial_sync

from test_pipelines import rows

EVENT = "op string, ts long, _id int, o struct<s:string,n:int>"


def test_a_save_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.save("c", spark.range(3))
    opened = store["c"]

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "move", dies)
        with pytest.raises(OSError):
            store.save("c", spark.range(5))
    assert store["c"].count() == 3
    store.save("c", store["c"].union(store["c"]))
    assert store["c"].count() == 6 and opened.count() == 3 and list(store) == ["c"]


def test_log_that_dies_keeps_the_old_one(spark, tmp_path, monkeypatch):
    repo = Repository(spark, str(tmp_path))
    first = repo.commit({"c": spark.range(2).withColumnRenamed("id", "_id")}, "one")
    with monkeypatch.context() as m:
        m.setattr(files, "move", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            repo.commit({"c": spark.range(4).withColumnRenamed("id", "_id")}, "two")
    assert Repository(spark, str(tmp_path)).resolve("HEAD") == first


def test_drop_and_undrop(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in (2, 4):
        store.save("c", spark.range(n))
        store.drop("c")
    assert list(store) == [] and store.dropped() == ["c", "c"]
    store.undrop("c")
    assert store["c"].count() == 4
    with pytest.raises(ValueError):
        store.undrop("c")
    with pytest.raises(KeyError):
        store.undrop("d")


def test_views_survive_the_session(spark, tmp_path):
    db = api.Database(spark, str(tmp_path))
    db.insert("c", [{"_id": 1, "n": 5}, {"_id": 2, "n": 7}])
    db.create_view("v", "c", [{"$match": {"n": 7}}])
    assert rows(api.Database(spark, str(tmp_path))["v"]) == [(2, 7)]


def test_bulk_write_counts_and_errors(spark, tmp_path):
    db = api.Database(spark, str(tmp_path))
    db.insert("c", [{"_id": 1, "n": 5}, {"_id": 2, "n": 7}])
    ops = [{"insertOne": {"document": {"_id": 1, "n": 0}}}, {"updateMany": {"filter": {}, "update": {"$inc": {"n": 1}}}}, {"deleteOne": {"filter": {"_id": 2}}}]
    assert db.bulk_write("c", ops)["errors"][0]["index"] == 0 and sorted(rows(db["c"])) == [(1, 5), (2, 7)]
    got = db.bulk_write("c", ops, ordered=False)
    assert (got["inserted"], got["matched"], got["deleted"], len(got["errors"])) == (0, 2, 1, 1) and rows(db["c"]) == [(1, 6)]


def test_merge_let(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save("t", spark.createDataFrame([(1, 10)], "_id int, n int"))
    new = spark.createDataFrame([(1, 5), (2, 6)], "_id int, n int")
    store.merge(new, {"into": "t", "let": {"add": "$n"}, "whenMatched": [{"$set": {"n": {"$add": ["$n", "$$add"]}}}]})
    assert sorted(rows(store["t"])) == [(1, 15), (2, 6)]


def test_late_events_do_not_overwrite(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.save("c", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "_id int, s string, n int"))
    for i, rows_ in enumerate([[("u", 5, 1, (None, 50)), ("d", 6, 2, None)], [("u", 3, 1, (None, 30)), ("u", 4, 2, ("late", 0))]]):
        spark.createDataFrame(rows_, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        apply_stream(follow(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema), store, "c", str(tmp_path / "cp")).awaitTermination()
    assert rows(store["c"]) == [(1, "a", 50)]
    compact(store, "c")
    assert store.pending("c") is None and rows(store["c"]) == [(1, "a", 50)]


def test_transactions_and_removed_fields(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "_id int, s string, n int")
    one = "struct<op:string,_id:int,o:struct<s:string,n:int>,unset:array<string>>"
    ev = spark.createDataFrame(
        [("u", 1, 1, (None, 9), ["s"], None), ("c", 2, None, None, None, [("i", 3, ("x", 1), None), ("u", 3, (None, 2), None), ("d", 2, None, None)])],
        f"op string, ts long, _id int, o struct<s:string,n:int>, unset array<string>, ops array<{one}>",
    )
    assert sorted(rows(apply_events(target, ev)), key=repr) == [(1, None, 9), (3, "x", 2)]


def test_initial_sync(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    copy = spark.createDataFrame([(1, "a", 5), (2, "b", 2)], "_id int, s string, n int")  # has seen ts 3 already
    ev = spark.createDataFrame([("u", 1, 2, (None, 7)), ("u", 3, 1, (None, 5)), ("d", 4, 2, None)], EVENT)
    initial_sync(store, "c", copy, ev, since=3)
    assert rows(store["c"]) == [(1, "a", 5)]


def test_open_merge_survives_and_goes_on(spark, tmp_path):
    repo = Repository(spark, str(tmp_path))
    s = "_id int, a int, b int"
    repo.commit({"c": spark.createDataFrame([(1, 1, 1), (2, 1, 1)], s)}, "base")
    repo.branch("dev")
    repo.commit({"c": spark.createDataFrame([(1, 2, 1), (2, 1, 1)], s)}, "ours")
    repo.checkout("dev")
    repo.commit({"c": spark.createDataFrame([(1, 3, 1), (2, 1, 5)], s)}, "theirs")
    repo.checkout("main")
    assert repo.merge("dev")[0] is None
    again = Repository(spark, str(tmp_path))
    assert [r["_id"] for r in again.conflicts()["c"].collect()] == [1]
    with pytest.raises(VersionError):
        again.merge("dev")
    again.merge_abort()
    assert again.merge("dev")[0] is None
    again.merge_continue("theirs")
    assert sorted(rows(again.read("c"))) == [(1, 3, 1), (2, 1, 5)] and again.stat() == {"c": {"modified": 2}}
    page, token = again.log_page(2)
    again.commit({"c": spark.createDataFrame([(1, 1, 1)], s)}, "later")
    rest, end = again.log_page(2, token)
    assert [c["message"] for c in page + rest] == ["merge dev", "theirs", "ours", "base"] and end is None
