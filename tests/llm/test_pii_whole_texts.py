import pytest

from lapidary.llm import pii


@pytest.mark.parametrize("sent_rows", [1000, 0])
def test_terms_far_from_their_entity(spark, sent_rows):
    """A name is marked at every place of a text, however far from the address; other texts are left alone."""
    filler = "common words stand here " * 40
    rows = [(i, filler) for i in range(60)]
    rows += [(100, f"Quibblefrost {filler} joe@mail.example {filler} quibblefrost"), (101, f"{filler} 10.0.0.1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.personal_data(frame, clean=True, sent_rows=sent_rows).select("doc_id", "text", "found.*").collect()}
    spans = [x.split(":") for x in got[100].spans.split(",")]
    assert [got[100].text[int(a) : int(b)] for k, a, b in spans if k == "term"] == ["Quibblefrost", "quibblefrost"]
    assert "uibblefrost" not in got[100].clean and "common words" in got[100].clean
    assert all("term" not in r.spans for i, r in got.items() if i != 100)
    found = {tuple(r) for r in pii.disclosing_terms(frame, sent_rows=sent_rows).collect()}
    assert found == {("email:joe@mail.example", "quibblefrost")}


def test_only_texts_with_an_entity_are_joined(spark):
    """Too many pairs to send: texts without an entity are not shuffled, and no text is read for its words again."""
    rows = [(i, f"common words {i} stand here") for i in range(60)] + [(100, "common words quibblefrost joe@mail.example")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(frame, clean=True, sent_rows=0)
    plain, joined = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)
    assert "Union" in plain and "NOT" in plain and "has_entity" in joined
    assert "MapInArrow" not in plain + joined
    got = {r.doc_id: r for r in found.select("doc_id", "text", "found.*").collect()}
    assert len(got) == 61 and got[100].clean == "common words  [EMAIL]"
    assert all(r.clean == r.text and r.spans == "" and r.n_email == 0 for i, r in got.items() if i != 100)
