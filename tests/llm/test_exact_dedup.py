import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lapidary.llm import common, exact_dedup


def rows():
    base = ["", None, " ", "\n", "a b", "a  b", "a\t\nb", "A b", "a b ", "é x", "é x", "long " * 4000]
    out = [(i, t, "en") for i, t in enumerate(base)]
    return out + [(None, "a b", None), (None, "only null", None), (4, "a b", "en"), (40, "hot", "de"), *((100 + i, "hot", None) for i in range(50)), (40, "hot", "x")]


def expected():
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows():
        groups[norm(t)].append(i)
    for i, t, _ in rows():
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        yield i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()


def found(frame, **kw):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in exact_dedup.decisions(frame, **kw).collect())


def test_decisions(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, digest string").repartition(3)
    want = sorted(str(x[:4]) for x in expected())
    assert found(frame) == want
    assert {r.digest for r in exact_dedup.decisions(frame).collect()} == {x[4] for x in expected()}
    # Keys that different texts share are told apart by the texts.
    assert found(frame, digest=lambda t: (F.length(t) % 3).cast("string")) == want
    assert found(frame.limit(0)) == []


def test_any_column_names_and_one_row_for_each_text(spark):
    names = ["digest", "norm", "row", "keep", "size", "place", "_text", "_digest", "_keep", "_size", "kept", "part", "nth", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t, _ in rows()], schema).repartition(2)
    for how in (exact_dedup.sha256_of, lambda t: (F.length(t) % 3).cast("string")):
        got = exact_dedup.kept_documents(frame, how)
        assert got.columns == frame.columns
        kept = got.collect()
        # a row for each text; rows that repeat an id stay once
        assert sorted(str(r.doc_id) for r in kept) == sorted(k for k, _ in {(str(x[0]), x[4]) for x in expected() if x[3]})
        assert all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names)
        marked = exact_dedup.deduplicate(frame, how).collect()
        assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in marked) == sorted(str(x[:4]) for x in expected())


def test_kept_texts_are_found_where_the_state_says(spark, tmp_path, monkeypatch):
    """Hits are compared with the text at the locator, also when a group is dealt out over parts."""
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    frame = spark.createDataFrame([(i, "hot") for i in range(300)] + [(1000 + i, f"text {i % 40}") for i in range(60)], "doc_id long, text string")
    frame.repartition(4).write.parquet(f"file://{tmp_path}/in")
    docs = spark.read.parquet(f"file://{tmp_path}/in")
    _, ledger = exact_dedup._ledger(docs, exact_dedup.sha256_of)
    assert {r.place for r in ledger.collect()} <= {r[0] for r in docs.select(F.input_file_name()).distinct().collect()}
    assert not exact_dedup._collisions(docs, ledger, exact_dedup.sha256_of)
    other = docs.withColumn("text", F.when(F.col("doc_id") == 77, "cold").otherwise(F.col("text")))
    one = lambda t: F.lit("x") if t is None else F.when(t.isin("hot", "cold"), "x").otherwise(t)
    _, ledger = exact_dedup._ledger(other, one)
    assert exact_dedup._collisions(other, ledger, one)
    assert {r.doc_id for r in exact_dedup.kept_documents(other, one).collect()} == {0, 77, *range(1000, 1040)}


def test_state_goes_on_after_a_restart(spark, tmp_path):
    schema = spark.createDataFrame([], "digest string, doc_id long, locator string").schema
    arrivals, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    for part, want in (([("d", 5, "x"), ("e", 1, "x")], (5, 1)), ([("d", 3, "y"), ("d", 9, "y")], (3, 3))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(arrivals)
        got = {r.digest: (r["first"].doc_id, r.group_size) for r in exact_dedup.run_ledger_stream(spark, arrivals, schema, state).collect()}
        assert got["d"] == want
    assert got["e"] == (1, 1)
