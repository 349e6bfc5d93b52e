"""A merge changes the buckets that it must and no others, twice is once, and one that was cut off is ended."""

import decimal
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lapidary.operators import state
from lapidary.sources import shared
from lapidary.sources.keyed import Keyed

SCHEMA = "k int, n string, v int"


@pytest.fixture
def store(spark):
    def made(**more):
        schema = spark.createDataFrame([], SCHEMA).schema
        return Keyed(spark, shared.new_path(spark, "keyed"), schema, ("k", "n"), **{"buckets": 8, **more})

    return made


def files(store):
    return {(r["bucket"], r["f"]) for r in store.placed().selectExpr("bucket", "_metadata.file_path AS f").distinct().collect()}


def content(store):
    return sorted(map(tuple, store.rows().collect()), key=str)


def test_only_changed_buckets_are_rewritten(spark, store):
    s = store()
    s.merge(spark.createDataFrame([(i, "a", i) for i in range(200)], SCHEMA))
    before = files(s)
    assert len({b for b, _ in before}) == 8
    changed = s.merge(spark.createDataFrame([(i, "a", i + (i == 7)) for i in range(200)], SCHEMA))
    after = files(s)
    assert len(changed) == 1
    assert {x for x in before if x[0] not in changed} == {x for x in after if x[0] not in changed}
    assert not {x for x in before if x[0] in changed} & after
    assert content(s) == sorted([(i, "a", i + (i == 7)) for i in range(200)], key=str)
    assert s.merge(spark.createDataFrame([(7, "a", 8)], SCHEMA)) == [] and files(s) == after


def test_random_merges_equal_a_dictionary(spark, store):
    rng, s, known = random.Random(3), store(near=("k",)), {}
    for _ in range(4):
        rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "", "x", "é"]), rng.choice([None, 1, 2, 3])) for _ in range(rng.choice([0, 3, 30]))]
        s.merge(spark.createDataFrame(rows, SCHEMA))
        best = {}
        for k, n, v in rows:
            best[k, n] = max(best.get((k, n), -1), -1 if v is None else v)
        known |= best
        assert content(s) == sorted([(k, n, None if v < 0 else v) for (k, n), v in known.items()], key=str)


def test_empty_and_repeated(spark, store):
    s = store()
    none = spark.createDataFrame([], SCHEMA)
    assert s.merge(none) == [] and content(s) == [] and s.merge(none) == []
    rows = [(1, "a", 5)] * 50 + [(1, "a", 4), (1, None, None)]
    assert s.merge(spark.createDataFrame(rows, SCHEMA)) and s.merge(none) == []
    assert content(s) == [(1, "a", 5), (1, None, None)]
    assert s.merge(spark.createDataFrame([(1, "a", 9, "z")], SCHEMA + ", extra string")) != []  # other columns are not stored
    assert content(s) == [(1, "a", 9), (1, None, None)]


def test_of_its_own_rows(spark, store):
    s = store()
    s.merge(spark.createDataFrame([(i, "a", i) for i in range(20)], SCHEMA))
    s.merge(s.rows().selectExpr("k", "n", "v + 1 AS v"))
    assert content(s) == sorted([(i, "a", i + 1) for i in range(20)], key=str)


def test_a_merge_cut_off_is_ended(spark, store, monkeypatch):
    s = store()
    s.merge(spark.createDataFrame([(i, "a", i) for i in range(20)], SCHEMA))

    def lost(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Keyed, "_swap", lost)
        with pytest.raises(RuntimeError):
            s.merge(spark.createDataFrame([(3, "a", 99)], SCHEMA))
    again = Keyed(spark, s.root, s.schema, s.key, s.buckets)
    assert (3, "a", 99) in content(again) and len(content(again)) == 20


def test_what_is_refused(spark, store):
    s = store()
    s.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    with pytest.raises(ValueError, match="buckets"):
        Keyed(spark, s.root, s.schema, s.key, 9).merge(spark.createDataFrame([(1, "a", 2)], SCHEMA))
    with pytest.raises(ValueError, match="share a bucket"):
        Keyed(spark, s.root, s.schema, s.key, near=("v",))
    with pytest.raises(ValueError, match="own columns"):
        Keyed(spark, s.root, spark.createDataFrame([], "Bucket int").schema, ("Bucket",))


def test_derived_rows(spark):
    schema = "document_id long, project_id long, work_item string, fact_type string, calculation_version string, numeric_value decimal(25,12), inputs array<struct<role string, fact_id string, provision_id string>>"
    D = decimal.Decimal
    inputs = [("rate", None, "p1"), ("cost", "f2", None), ("area", "f1", None)]
    rows = spark.createDataFrame([(None, 1, "a", "v", "1", D("0.000000000050"), inputs), (2, None, None, "v", "1", D("0.000000000150"), None), (None, None, "a", "v", "1", None, []), (1, 1, None, "v", "1", D(1), [])], schema)
    got = [r.asDict() for r in state.derived_rows(rows).collect()]
    assert [(r["fact_type"], r["numeric_value"], r["refused"] is None) for r in got] == [("a:v", D("0E-10"), True), ("v", D("0.0000000002"), True), ("a:v", None, False), ("v", D("1.0000000000"), False)]
    assert [x["role"] for x in got[0]["inputs"]] == ["area", "cost", "rate"] and got[1]["inputs"] == []
    listed = rows.filter("work_item = 'a' AND project_id = 1").selectExpr("project_id AS derived_id", "explode(inputs) AS i").selectExpr("derived_id", "i.*")
    assert got[0]["inputs_fingerprint"] == state.inputs_fingerprint(listed, ["derived_id"]).first()["fingerprint"] == hashlib.sha256(b"area=f1|cost=f2|provision:rate=p1").hexdigest()


def test_a_changed_bucket_is_written_once(spark, store):
    """Folders are moved, not copied; one that was moved before a run was cut off stays, and the others follow."""
    s = store()
    written = []
    write = s._write
    s._write = lambda rows, path, **how: written.append(path) or write(rows, path, **how)
    s.merge(spark.createDataFrame([(i, "a", i) for i in range(50)], SCHEMA))
    assert written == [s.pending]
    moved = []
    s._swap = lambda: moved.extend(r["f"].rsplit("/", 1)[1] for r in s._read(s.pending).selectExpr("_metadata.file_path AS f").distinct().collect())
    s.merge(spark.createDataFrame([(i, "a", -i) for i in range(50)], SCHEMA))
    again = Keyed(spark, s.root, s.schema, s.key, s.buckets)
    files_, folder = again._path(f"{s.pending}/buckets=8")
    one = files_.listStatus(folder)[0].getPath()
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{s.table}/buckets=8/{one.getName()}")
    assert files_.delete(old, True) and files_.rename(one, old)
    assert content(again) == sorted([(i, "a", -i) for i in range(50)], key=str)
    assert {f.rsplit("/", 1)[1] for _, f in files(again)} == {*moved}


def test_stored_rows_are_not_shuffled(spark, store):
    """Incoming rows are shuffled once, and before that reduced if keys repeat; what is compared and rewritten lies in the same parts."""
    s = store()
    write, plans = s._write, []

    def seen(rows, path, **how):
        parts = rows._jdf.queryExecution().executedPlan().toString().split("Exchange hash")
        plans.append((path, len(parts) - 1, len(parts) > 1 and "partial_max" in parts[-1]))  # shuffles, and whether rows are reduced before the first
        write(rows, path, **how)

    s._write = seen
    s.merge(spark.range(500).selectExpr("CAST(id AS int) AS k", "CAST(id % 7 AS string) AS n", "1 AS v"))
    s.merge(spark.range(300).selectExpr("CAST(id * 5 AS int) AS k", "CAST(id * 5 % 7 AS string) AS n", "2 AS v"))
    assert plans == [(s.pending, 1, False), (s.incoming, 1, False), (s.pending, 0, False)]
    assert content(s) == sorted([(k, str(k % 7), 1 + (k % 5 == 0)) for k in range(1500) if k < 500 or k % 5 == 0], key=str)
    plans.clear()
    s.merge(spark.range(1000).selectExpr("CAST(id % 3 AS int) AS k", "CAST(id % 3 AS string) AS n", "CAST(id AS int) AS v"), (-F.col("v"),))
    assert plans == [(s.incoming, 1, True), (s.pending, 0, False)]
    assert [r for r in content(s) if r[0] < 3] == [(0, "0", 0), (1, "1", 1), (2, "2", 2)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("keyed_")]


def test_a_fingerprint_is_told_from_stored_inputs(spark):
    inputs = [("rate", None, "p1"), ("cost", "f2", None), ("area", "f1", None)]
    schema = "document_id long, project_id long, work_item string, fact_type string, calculation_version string, numeric_value decimal(25,12), inputs array<struct<role string, fact_id string, provision_id string>>"
    rows = state.derived_rows(spark.createDataFrame([(1, None, None, "v", "1", decimal.Decimal(1), inputs), (2, None, None, "v", "1", None, None)], schema))
    assert rows.filter(state.listed_fingerprint("inputs") == F.col("inputs_fingerprint")).count() == 2


def test_a_constant_of_the_key_costs_no_shuffle(spark, store):
    """Spark neither groups nor shuffles by a constant, so it is left out of what deals rows (facts of one type)."""
    s = store(near=("k",))
    write, plans = s._write, []
    s._write = lambda rows, path, **how: plans.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange hash")) or write(rows, path, **how)
    for part in (0, 1):
        s.merge(spark.range(100).filter(f"id % 2 = {part}").selectExpr("CAST(id AS int) AS k", "'amount' AS n", "CAST(id AS int) AS v"))
    assert plans == [1, 1, 0] and sorted(content(s)) == [(k, "amount", k) for k in range(100)]
