"""Stages, filters, updates, versions and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from lattica import api
from lattica.operators.updates import delete, update
from lattica.plans.pipeline import REFUSED, PipelineError, stages
from lattica.sources.store import merge
from lattica.sources.versioning import Repository, diff, resolve, three_way
from lattica.streaming.cdc import apply_events, apply_stream, follow


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a", [1, 5], 10.0), (2, "b", [], None), (3, None, None, 30.0), (4, "a", [9], 40.0)], "_id int, k string, xs array<int>, v double")


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.mark.parametrize("spec, want", [
    ({}, [1, 2, 3, 4]), ({"k": "a"}, [1, 4]), ({"k": None}, [3]), ({"k": {"$ne": "a"}}, [2, 3]), ({"k": {"$nin": ["a"]}}, [2, 3]), ({"v": {"$gt": 10}}, [3, 4]), ({"v": {"$lte": None}}, [2]),
    ({"v": {"$not": {"$gt": 10}}}, [1, 2]), ({"xs": 5}, [1]), ({"xs": {"$gt": 4}}, [1, 4]), ({"xs": []}, [2]), ({"xs": {"$size": 1}}, [4]), ({"xs": {"$all": [1, 5]}}, [1]), ({"xs": {"$all": []}}, []),
    ({"xs": {"$elemMatch": {"$gt": 1, "$lt": 6}}}, [1]), ({"xs": {"$exists": False}}, [3]), ({"k": {"$exists": True}}, [1, 2, 4]), ({"k": {"$in": [None, "b"]}}, [2, 3]), ({"k": {"$regex": "^A", "$options": "i"}}, [1, 4]),
    ({"$or": [{"k": "b"}, {"v": 30}]}, [2, 3]), ({"$nor": [{"k": "a"}]}, [2, 3]), ({"$expr": {"$gt": ["$v", "$_id"]}}, [1, 3, 4]), ({"_id": {"$mod": [2, 0]}}, [2, 4]), ({"k": {"$type": "string"}}, [1, 2, 4]),
    ({"_id": {"$bitsAnySet": [0]}}, [1, 3]), ({"k": 5}, []), ({"v": "x"}, []), ({"missing": None}, [1, 2, 3, 4]), ({"$alwaysFalse": 1}, []), ({"$jsonSchema": {"required": ["k"], "properties": {"xs": {"minItems": 1}}}}, [1, 4]),
])
def test_filters(docs, spec, want):
    assert ids(api.find(docs, spec)) == want


def test_stage_registry():
    assert {"$match", "$group", "$lookup", "$graphLookup", "$setWindowFields", "$densify", "$fill", "$facet", "$bucketAuto", "$merge", "$out", "$redact", "$geoNear"} <= set(stages())


def test_refused_and_misplaced(docs):
    for s in REFUSED:
        with pytest.raises(PipelineError):
            api.aggregate(docs, [{s: {}}])
    with pytest.raises(PipelineError):
        api.aggregate(docs, [{"$out": "x"}, {"$limit": 1}])
    with pytest.raises(PipelineError):
        api.aggregate(docs, [{"$limit": 0}])


def test_projection_forms(docs):
    assert api.aggregate(docs, [{"$project": {"k": 1}}]).columns == ["_id", "k"]
    assert api.aggregate(docs, [{"$project": {"_id": 0, "d": {"$add": ["$v", 1]}}}]).columns == ["d"]
    assert api.aggregate(docs, [{"$project": {"xs": 0}}]).columns == ["_id", "k", "v"]
    nested = api.aggregate(docs, [{"$set": {"o.p": "$v", "o.q": 1}}, {"$project": {"o.p": 1, "_id": 0}}])
    assert nested.schema["o"].dataType.fieldNames() == ["p"]
    assert rows(api.find(docs, {"xs": {"$gt": 4}}, {"xs.$": 1}).orderBy("_id")) == [(1, [5]), (4, [9])]
    assert rows(api.find(docs, {"_id": 1}, {"xs": {"$slice": -1}, "k": 1}))[0][-1] == [5]


def test_group_edge_cases(docs, spark):
    got = {r["_id"]: r for r in api.aggregate(docs, [{"$sort": {"_id": -1}}, {"$group": {"_id": "$k", "s": {"$sum": "$v"}, "a": {"$avg": "$v"}, "p": {"$push": "$v"}, "f": {"$first": "$_id"}, "z": {"$sum": "$k"}}}]).collect()}
    assert got["a"].s == 50.0 and got["a"].f == 4 and got["a"].p == [40.0, 10.0]
    assert got["b"].s == 0 and got["b"].a is None and got["b"].p == [None] and got["b"].z == 0
    assert api.aggregate(docs.limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}]).count() == 0
    assert api.aggregate(docs.limit(0), [{"$count": "n"}]).count() == 0


def test_unwind(docs):
    assert rows(api.aggregate(docs, [{"$unwind": "$xs"}, {"$sort": {"xs": 1}}, {"$project": {"xs": 1}}])) == [(1, 1), (1, 5), (4, 9)]
    kept = api.aggregate(docs, [{"$unwind": {"path": "$xs", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}])
    assert kept.count() == 5 and kept.filter("_id = 2").first()["i"] is None


def test_lookup_null_matches_null_and_arrays(docs, spark):
    other = spark.createDataFrame([(10, "a"), (11, None)], "_id int, k string")
    got = {r["_id"]: [x["_id"] for x in r["m"]] for r in api.aggregate(docs, [{"$lookup": {"from": "o", "localField": "k", "foreignField": "k", "as": "m"}}], {"o": other}).collect()}
    assert got == {1: [10], 2: [], 3: [11], 4: [10]}
    nums = spark.createDataFrame([(5,), (9,)], "n int")
    got = {r["_id"]: sorted(x["n"] for x in r["m"]) for r in api.aggregate(docs, [{"$lookup": {"from": "n", "localField": "xs", "foreignField": "n", "as": "m"}}], {"n": nums}).collect()}
    assert got == {1: [5], 2: [], 3: [], 4: [9]}


def test_graph_lookup(spark):
    people = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "d", "d")], "_id int, name string, boss string")
    spec = {"from": "p", "startWith": "$boss", "connectFromField": "boss", "connectToField": "name", "as": "up", "depthField": "d"}
    got = {r["name"]: [(x["name"], x["d"]) for x in r["up"]] for r in api.aggregate(people, [{"$graphLookup": spec}], {"p": people}).collect()}
    assert got == {"a": [], "b": [("a", 0)], "c": [("b", 0), ("a", 1)], "d": [("d", 0)]}


def test_windows_fill_and_densify(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 3, None), (1, 5, 30.0), (2, 1, 7.0)], "g int, t int, v double")
    out = api.aggregate(df, [{"$fill": {"partitionByFields": ["g"], "sortBy": {"t": 1}, "output": {"v": {"method": "linear"}}}}]).orderBy("g", "t")
    assert [r.v for r in out.collect()] == [10.0, 20.0, 30.0, 7.0]
    dense = api.aggregate(df, [{"$densify": {"field": "t", "partitionByFields": ["g"], "range": {"step": 1, "bounds": "partition"}}}])
    assert sorted((r.g, r.t) for r in dense.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]
    w = api.aggregate(df, [{"$setWindowFields": {"partitionBy": "$g", "sortBy": {"t": 1}, "output": {"s": {"$sum": "$v", "window": {"range": [-2, 0]}}, "r": {"$denseRank": {}}, "e": {"$expMovingAvg": {"input": "$v", "N": 1}}}}}]).orderBy("g", "t")
    assert [r.s for r in w.collect()] == [10.0, 10.0, 30.0, 7.0]


def test_updates(docs, spark):
    assert rows(update(docs, {"k": "a"}, {"$inc": {"v": 1}, "$push": {"xs": {"$each": [7], "$sort": -1}}, "$unset": {"k": 1}}).filter("_id = 1")) == [(1, None, [7, 5, 1], 11.0)]
    assert rows(update(docs, {"k": "a"}, {"$set": {"v": 0.0}}, multi=False).filter("v = 0").select("_id")) == [(1,)]
    assert rows(update(docs, {"xs": 5}, {"$set": {"xs.$": 6}}).filter("_id = 1").select("xs")) == [([1, 6],)]
    assert rows(update(docs, {}, {"$set": {"xs.$[e]": 0}}, array_filters=[{"e": {"$gt": 4}}]).orderBy("_id").select("xs")) == [([1, 0],), ([],), (None,), ([0],)]
    assert rows(update(docs, {}, {"$pull": {"xs": {"$gt": 4}}}).filter("_id = 1").select("xs")) == [([1],)]
    assert rows(update(docs, {}, {"$addToSet": {"xs": 5}, "$max": {"v": 20}, "$bit": {"_id": {"or": 0}}}).orderBy("_id").select("xs", "v"))[:2] == [([1, 5], 20.0), ([5], 20.0)]
    assert update(docs, {"_id": 9, "k": "z"}, {"$set": {"v": 1.0}, "$setOnInsert": {"xs": [1]}}, upsert=True).filter("_id = 9 and k = 'z' and v = 1").count() == 1
    assert ids(delete(docs, {"k": "a"}, 1)) == [2, 3, 4]
    assert rows(update(docs, {"_id": 2}, {"k": "new"}).filter("_id = 2")) == [(2, "new", None, None)]


def test_merge_modes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "_id int, s string, n int")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "_id int, s string")
    assert sorted(rows(merge(t, s, {"into": "t"}))) == [(1, "a", 1), (2, "B", 2), (3, "C", None)]
    assert (2, "B", None) in rows(merge(t, s, {"into": "t", "whenMatched": "replace"}))
    assert (2, "b", 2) in rows(merge(t, s, {"into": "t", "whenMatched": "keepExisting"}))
    assert merge(t, s, {"into": "t", "whenNotMatched": "discard"}).count() == 2
    assert (2, "B", 3) in rows(merge(t, s, {"into": "t", "whenMatched": [{"$set": {"s": "$$new.s", "n": {"$toInt": {"$add": ["$n", 1]}}}}]}))
    with pytest.raises(Exception):
        merge(t, s, {"into": "t", "whenMatched": "fail"}).collect()


def test_database(spark, tmp_path):
    db = api.Database(spark, str(tmp_path))
    db.insert("c", [{"_id": 1, "n": 5}, {"_id": 2, "n": 7}])
    with pytest.raises(ValueError):
        db.insert("c", [{"_id": 1, "n": 0}])
    db.update("c", {"n": {"$gt": 6}}, {"$inc": {"n": 1}})
    assert db.find_and_modify("c", {"_id": 1}, {"$set": {"n": 9}}, new=True)["n"] == 9
    db.aggregate("c", [{"$match": {"n": 8}}, {"$out": "d"}])
    assert rows(db["d"]) == [(2, 8)]
    db.aggregate("c", [{"$set": {"n": 0}}, {"$merge": {"into": "d"}}])
    assert sorted(rows(db["d"])) == [(1, 0), (2, 0)]
    db.create_view("v", "c", [{"$match": {"n": 9}}])
    assert db["v"].count() == 1
    db.bulk_write("c", [{"insertOne": {"document": {"_id": 3, "n": 1}}}, {"updateMany": {"filter": {}, "update": {"$mul": {"n": 2}}}}, {"deleteOne": {"filter": {"_id": 2}}}])
    assert sorted(rows(db["c"])) == [(1, 18), (3, 2)]


def test_three_way_matrix(spark):
    s = "_id int, a int, b int"
    base = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1)], s)
    ours = spark.createDataFrame([(1, 2, 1), (2, 2, 1), (4, 1, 1), (5, 7, 1), (6, 0, 0)], s)
    theirs = spark.createDataFrame([(1, 1, 2), (2, 3, 1), (3, 1, 9), (5, 7, 1), (6, 0, 1)], s)
    got, open_ = three_way(base, ours, theirs)
    assert sorted(r["_id"] for r in open_.collect()) == [2, 3, 6]
    assert (1, 2, 2) in rows(got) and (5, 7, 1) in rows(got) and 4 not in ids(got)
    assert sorted(rows(resolve(got, open_, "theirs"))) == [(1, 2, 2), (2, 3, 1), (3, 1, 9), (5, 7, 1), (6, 0, 1)]
    assert sorted(r["_id"] for r in three_way(base, ours, theirs, "row")[1].collect()) == [1, 2, 3, 6]
    assert (2, 2, 1) in rows(three_way(base, ours, theirs, "ours")[0]) and (2, 3, 1) in rows(three_way(base, ours, theirs, "theirs")[0])


def test_repository(spark, tmp_path):
    repo = Repository(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "_id int, s string")
    first = repo.commit({"c": a}, "one")
    repo.branch("dev")
    repo.checkout("dev")
    second = repo.commit({"c": a.withColumn("s", F.when(F.col("_id") == 1, "X").otherwise(F.col("s")))}, "two")
    repo.checkout("main")
    repo.commit({"c": a.union(spark.createDataFrame([(3, "z")], a.schema))}, "three")
    assert repo.branch_status("main", "dev") == (1, 1)
    assert rows(repo.diff("c", "main~1", "dev").select("_id", "change")) == [(1, "modified")]
    tip, open_ = repo.merge("dev")
    assert not open_ and sorted(rows(repo.read("c"))) == [(1, "X"), (2, "y"), (3, "z")]
    assert repo.resolve("HEAD^2") == second and repo.resolve("HEAD~2") == first
    assert [c["message"] for c in repo.log(collection="c", filter={"_id": 3})][-1] == "three"
    repo.revert("HEAD~1")
    assert sorted(ids(repo.read("c"))) == [1, 2]
    repo.tag("t", "main~1")
    assert Repository(spark, str(tmp_path)).resolve("t") == repo.resolve("main~1")


def test_diff_nested(spark):
    a = spark.sql("select 1 as _id, struct(1 as x, struct('p' as y) as z) as o")
    b = spark.sql("select 1 as _id, struct(1 as x, struct('q' as y) as z) as o")
    assert [(c["path"], c["from"], c["to"]) for c in diff(a, b).first()["changed"]] == [("o.z.y", "p", "q")]


def test_events_and_stream(spark, tmp_path):
    s = "op string, ts long, _id int, o struct<s:string,n:int>"
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "_id int, s string, n int")
    ev = spark.createDataFrame([("u", 1, 1, (None, 5)), ("d", 2, 2, None), ("i", 3, 4, ("d", 4)), ("u", 4, 4, (None, 9)), ("d", 5, 3, None), ("i", 6, 3, ("C", None)), ("u", 7, 99, ("?", 0)), ("n", 8, 1, None)], s)
    want = [(1, "a", 5), (3, "C", None), (4, "d", 9)]
    assert sorted(rows(apply_events(target, ev))) == want
    assert sorted(rows(apply_events(apply_events(target, ev), ev))) == want
    db = api.Database(spark, str(tmp_path / "db"))
    db.store.save("c", target)
    ev.repartition(1).write.parquet(str(tmp_path / "in"))
    apply_stream(follow(spark, str(tmp_path / "in"), ev.schema), db.store, "c", str(tmp_path / "cp")).awaitTermination()
    assert sorted(rows(db.store["c"])) == want


def test_geo(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "_id int, loc array<double>")
    square = {"type": "Polygon", "coordinates": [[[-1, -1], [-1, 1], [1, 1], [1, -1], [-1, -1]]]}
    for spec in ({"$geoWithin": {"$geometry": square}}, {"$geoWithin": {"$box": [[-1, -1], [1, 1]]}}, {"$geoIntersects": {"$geometry": square}}, {"$geoWithin": {"$centerSphere": [[0, 0], 0.01]}}, {"$near": [0, 0], "$maxDistance": 2}):
        assert ids(api.find(df, {"loc": spec})) == [1]
    lines = spark.createDataFrame([(1, ("LineString", [[-2.0, 0.0], [2.0, 0.0]])), (2, ("LineString", [[3.0, 3.0], [4.0, 4.0]]))], "_id int, g struct<type:string,coordinates:array<array<double>>>")
    assert ids(api.find(lines, {"g": {"$geoIntersects": {"$geometry": square}}})) == [1]


def test_lookup_fusion_plans(docs, spark):
    other = spark.createDataFrame([(10, "a")], "oid int, k string")
    look = {"$lookup": {"from": "o", "localField": "k", "foreignField": "k", "as": "m"}}
    fused = api.aggregate(docs, [look, {"$unwind": "$m"}], {"o": other})
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan
    anti = api.aggregate(docs, [look, {"$match": {"m": {"$size": 0}}}, {"$unset": "m"}], {"o": other})
    assert "LeftAnti" in anti._jdf.queryExecution().optimizedPlan().toString() and ids(anti) == [2, 3]
