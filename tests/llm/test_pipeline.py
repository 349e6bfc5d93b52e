"""The pipeline against brute force on a small corpus, stage by stage."""

import hashlib
import random
import re

import pyarrow as pa
import tiktoken

import corpus_pipeline
from lapidary.llm import byte_bpe, decontaminate, quality
from tests.llm import test_decontaminate, test_jaccard_join
from tests.llm.test_quality import made

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    passage = " ".join(f"item{i}" for i in range(14))
    rows = [(i, made(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(160)]
    good = [t for _, t, q in rows if q and len(t.split()) > 40]
    rows += [(200 + i, good[i].replace(" ", "  \n", 3), 1) for i in range(5)]  # copies but for white space
    rows += [(300 + i, good[i].replace(good[i].split()[3], "other", 1), 1) for i in range(5)]  # near copies
    rows += [(400 + i, f"{good[-1 - i][:60]} so {passage}, and on", 1) for i in range(3)]
    rows += [(None, "a row without an id stays alone here", 1), (500, None, 1), (501, "", 1)]
    return rows, [(1, passage), (2, None)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    at = f"file://{tmp_path}"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t, _ in rows], COLUMNS)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, q) for d, _, q in rows if d is not None], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")

    model = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    scores = model.scores(pa.array([t or "" for _, t, _ in rows]))
    want = [(d, t) for (d, t, _), s in zip(rows, scores, strict=True) if s >= corpus_pipeline.REJECT_UNDER]
    assert 100 < len(want) < len(rows)
    firsts = {}
    for d, t in want:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in firsts or (d is not None and (firsts[key] is None or d < firsts[key])):
            firsts[key] = d
    want = [(d, t) for d, t in want if firsts[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")] == d]
    want = [(d, t) for (d, t), (_, c, _, _) in zip(want, test_jaccard_join.brute(want), strict=True) if d is None or d == c]
    hit = {x[0]: x[5] for x in test_decontaminate.brute(want, items)}
    assert sum(hit.values()) == 3
    path, pattern = byte_bpe.public_vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.encoder(path, pattern).rank, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert set(got) == {d for d, _ in want}
    for d, t in want:
        text = (t or "").replace(items[0][1], "") if hit[d] else t or ""
        ids = theirs.encode_ordinary(text)
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 27)], COLUMNS)
    assert len(corpus_pipeline.STAGES) == 5
    assert decontaminate.decontaminated(docs, spark.createDataFrame([], "item_id long, text string")).columns == docs.columns


def test_empty_tables_and_columns_of_their_own(spark, tmp_path):
    for name, n in (("none", 0), ("some", 8)):
        at = f"file://{tmp_path}/{name}"
        rows = [(i % 6, f"text number {i} of a few words that nobody else has {i * i}", "en", "s", 5, 1, "k", "f") for i in range(n)]
        spark.createDataFrame(rows, COLUMNS + ", t long, key string, found string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == [c.split()[0] for c in (COLUMNS + ", t long, key string, found string").split(", ")]
        assert corpus_pipeline.run(spark, at).count() <= n
