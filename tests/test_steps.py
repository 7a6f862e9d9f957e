"""JSON text, ordered steps and trees."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import records
from ledgerloom.operators import steps
from ledgerloom.operators.changes import ChangeSet


def test_json_text(spark):
    texts = ['{"a": 1, "n": null, "lines": [{"x": "p", "q": 2}, {"x": 3}, 7]}', '{"lines": {}}', "[1, 2]", "no json", '{"a":', None, "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert records.rejects(rows, "t").first().asDict() == {"texts": 6, "malformed": 2}
    out = records.elements(rows, "t", "$.lines", {"x": ("$.x", "string"), "q": ("$.q", "int")}).orderBy("i", "place").collect()
    assert [(r.i, r.place, r.x, r.q) for r in out] == [(0, 0, "p", 2), (0, 1, "3", None), (0, 2, None, None)]
    flags = rows.select("i", *(records.has_key(records.parsed(F.col("t")), k).alias(k) for k in ("a", "n", "z"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in flags][:2] == [(True, True, False), (False, False, False)]
    pairs = spark.createDataFrame([('{"a": 1, "b": {"c": 1}}', '{"b": {"d": 2}, "e": [null]}'), (None, '{"a": 1}'), ("[1]", None)], "old string, new string")
    assert [json.loads(r.m) for r in pairs.select(records.merged(F.col("old"), F.col("new")).alias("m")).collect()] == [{"a": 1, "b": {"d": 2}, "e": [None]}, {"a": 1}, {}]


def test_steps_run_once_and_in_order(spark):
    tables = {"t": spark.createDataFrame([(1, 10), (2, 20)], "id long, x long")}

    def add(n):
        return lambda now: {"t": ChangeSet(now["t"].withColumn("x", F.col("x") + n), now["t"])}

    def drop(now):
        return {"t": ChangeSet(now["t"].where("false"), now["t"].where("x > 21"))}

    first = [steps.Step("one", "add 1", add(1)), steps.Step("two", "drop", drop)]
    out, applied, done = steps.run_steps(tables, steps.no_steps(spark), first, {"t": ["id"]})
    assert sorted(map(tuple, out["t"].collect())) == [(1, 11), (2, 21)] and list(done) == ["one", "two"]
    again, same, nothing = steps.run_steps(out, applied, first, {"t": ["id"]})
    assert nothing == {} and same.count() == 2 and again["t"].count() == 2
    more, applied, done = steps.run_steps(out, applied, [*first, steps.Step("three", "add 5", add(5))], {"t": ["id"]})
    assert list(done) == ["three"] and sorted(map(tuple, more["t"].collect())) == [(1, 16), (2, 26)]
    for bad in ([steps.Step("one", "add 2", add(2)), *first[1:]], first[::-1], first[:1], [first[0], first[0]]):
        with pytest.raises(ValueError):
            steps.run_steps(more, applied.where("place < 2"), bad, {"t": ["id"]})


def test_trees_hand_on_ids(spark):
    current = spark.createDataFrame([(5, None, "food"), (6, 5, "out")], "id long, parent_id long, name string")
    nodes = [("food", []), ("out", ["food"]), ("home", ["food"]), ("rent", []), ("out", ["rent"]), ("deep", ["food", "home"]), ("rent", [])]
    frame = spark.createDataFrame([(n, [(p,) for p in ps]) for n, ps in nodes], "name string, parents array<struct<name: string>>")
    rows = steps.insert_tree(frame, current, ["name"]).collect()
    by = {(r.name, r.parent_id): r.id for r in rows}
    rent = by["rent", None]
    home = by["home", 5]
    assert set(by) == {("rent", None), ("home", 5), ("out", rent), ("deep", home)} and len(set(by.values()) | {5, 6}) == 6
    assert steps.insert_tree(frame.where("false"), current, ["name"]).count() == 0
    with pytest.raises(ValueError):
        steps.insert_tree(spark.createDataFrame([("x", [("nowhere",)])], frame.schema), current, ["name"]).count()
