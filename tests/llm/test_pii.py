import hashlib
import math
import random
import re

import pytest

from lapidary.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The stated forms, as they stand."""
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = 0
                for i, d in enumerate(map(int, digits[::-1])):
                    total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


def texts():
    rng = random.Random(11)
    yield from ["", "a@b.c a@b@c.d @x.y a.@b-.c.d.", "1.2.3.4.5.6.7.8 0255.001.2.3 256.1.1.1 12..3.4.5", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111", "+1 (555) 123-4567 +1 2 +12345678901234567890 ++123456789", "é1.1.1.1é me@é.com x@y.z9"]
    for _ in range(3000):
        alphabet = rng.choice(["a1.@ -", "0123456789. ", "01 -+", "+1(). -2", "ab@.-_%+1 é"])
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))


def test_base_spans_equal_the_stated_forms():
    for text in texts():
        assert pii.base_spans(text) == list(plain(text)), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "@" * 300_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(run)


def corpus():
    """One address that many texts have near the word quibblefrost, which stands nowhere else."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("bar", "lim", "tos") for b in ("ena", "ilo") for c in ("rin", "vek", "sul")]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{fill(20)} quibblefrost joe@mail.example {fill(20)}") for i in range(6)]
    rows += [(10 + i, f"{fill(30)} {rng.choice(['', 'ann@mail.example '])}{fill(9)}") for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "ip 10.0.0.1"), (0, rows[0][1]), (102, "quibblefrost")]


@pytest.mark.parametrize("sent_rows", [1000, 0])
def test_terms(spark, sent_rows):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(3)
    got = pii.personal_data(frame, clean=True, disclosure=0.8, sent_rows=sent_rows).select("doc_id", "text", "found.*").collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        base = list(plain(text))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        terms = [x.split(":") for x in r.spans.split(",") if x.startswith("term")]
        near = "quibblefrost joe@" in text
        assert [text[int(a) : int(b)] for _, a, b in terms] == (["quibblefrost"] if near else [])
        assert "joe@" not in r.clean and (not near or "quibblefrost" not in r.clean)
    found = pii.disclosing_terms(frame, disclosure=0.8, sent_rows=sent_rows).collect()
    assert [tuple(r) for r in found] == [("email:joe@mail.example", "quibblefrost")]


@pytest.mark.parametrize("sent_rows", [1000, 0])
def test_terms_beside_an_entity_seen_once(spark, sent_rows):
    """With the registered threshold: names that stand nowhere else are marked, common words are not."""
    rows = [(i, "common words stand here") for i in range(60)]
    rows += [(100, "common words quibblefrost joe@mail.example"), (101, "İstanbul +1 (555) 123-4567 10.0.0.1 common words")]
    rows += [(102, "x" * 70 + " brindlewick " + "1 " * 90 + "ann@mail.example common words stand")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(frame, clean=True, sent_rows=sent_rows).select("doc_id", "text", "found.*").collect()}

    def marked(i):
        spans = [x.split(":") for x in got[i].spans.split(",") if x.startswith("term")]
        return [got[i].text[int(a) : int(b)] for _, a, b in spans]

    assert marked(100) == ["quibblefrost"] and "quibblefrost" not in got[100].clean
    assert marked(101) == ["İstanbul"]
    assert marked(102) == ["x" * 70, "brindlewick"]
    found = {tuple(r) for r in pii.disclosing_terms(frame, sent_rows=sent_rows).collect()}
    assert ("ip:10.0.0.1", "İstanbul".lower()) in found and ("email:joe@mail.example", "quibblefrost") in found
    assert all(t not in ("common", "words") for _, t in found)


@pytest.mark.parametrize("sent_rows", [1000, 0])
def test_disclosure_against_counting(spark, sent_rows):
    """Mutual information of all pairs by counting documents one by one."""
    rows = [t for _, t in corpus()] + ["call +1 (555) 123-4567 Brindle now", "Brindle and brindle +1 555 123 4567", "at 10.0.0.1 barenarin joe@mail.example end"]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, key string, pairs string")
    with_word, with_entity, with_both = {}, {}, {}
    for t in rows:
        own = list(plain(t or ""))
        taken = [(a, b) for _, a, b in own]
        said = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")]
        free = [(a, b) for a, b in said if not any(a < y and x < b for x, y in taken)]
        names, pairs = set(), set()
        for kind, a, b in own:
            value = t[a:b]
            name = f"{kind}:" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
            names.add(name)
            before, behind = [x for x in free if x[1] <= a][-4:], [x for x in free if x[0] >= b][:4]
            pairs |= {(name, t[x:y].lower()) for x, y in before + behind}
        for counts, keys in ((with_word, {t[a:b].lower() for a, b in said}), (with_entity, names), (with_both, pairs)):
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
    n, want = len(rows), set()
    for (e, w), both in with_both.items():
        information = math.log2(n / with_entity[e])
        if information > 0 and math.log2(n * both / (with_word[w] * with_entity[e])) >= 0.9 * information:
            want.add((e, w))
    assert {tuple(r) for r in pii.disclosing_terms(frame, sent_rows=sent_rows).collect()} == want and want
    got = pii.personal_data(frame, clean=True, sent_rows=sent_rows, name="key")
    assert got.columns == frame.columns and {r.pairs for r in got.collect()} == {"y"}


def test_edges(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert pii.found_spans(frame.limit(0)).collect() == []
    got = {r.doc_id: r for r in pii.found_spans(frame).collect()}
    assert got[None].n_ip == 1 and got[100].spans == "" and got[0].n_email == 1
