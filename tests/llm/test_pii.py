from __future__ import annotations

import hashlib
import re

import pytest
from fixtures import FOLDER, awkward, empty

from featloom.llm import pii
from featloom.llm.pii import Disclosure, find_spans, personal_data, sanitise

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    """The definitions, as patterns."""
    text = text or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@pytest.mark.parametrize(
    "text",
    [
        "a@b@c.com x@y.z.w. .@-.- a@b. @c.d é.x+y@ö.de q@1.2 a@b.c@d.e",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 1.2.3.4567 0000000255.1.1.1",
        "4111 1111 1111 1111, 4111-1111-1111-1111-0 4111111111111111 41111111111111112222 1",
        "+1 (555) 123-4567 +12 +1--2 +49.30.1234567+49 30 +123456789012345678 +1 2345 67-",
        "mail\nme@host.org\tat 10.0.0.1 or +44 20 7946 0958 :é🙂 me@host.org",
        "",
    ],
)
def test_patterns(text):
    assert find_spans(text) == plain(text)


def test_long_runs_are_linear():
    assert find_spans("1" * 200_000) == [] and find_spans("a." * 100_000 + "@") == []
    assert len(find_spans("+1" * 50_000)) == 0


def check(docs):
    got = personal_data(docs).collect()
    wanted = []
    for r in docs.collect():
        spans = plain(r.text)
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        wanted.append((str(r.doc_id), *(sum(s[0] == k for s in spans) for k in range(4)), base))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in got) == sorted(wanted)
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert sum(r.n_email for r in got) > 5


def test_awkward_rows(spark):
    check(awkward(spark))
    assert personal_data(empty(spark)).count() == 0
    assert sanitise(empty(spark)).columns == empty(spark).columns


@pytest.fixture
def corpus(spark):
    rows = [(i, f"story {i} of the day: Zanzibor wrote to jo@x.org about item {i * 7} and left") for i in range(8)]
    rows += [(100 + i, f"plain text {i} of the day about item {i}") for i in range(50)]
    rows += [(200, "nobody but Zanzibor, knows this")]
    rows += [(300 + i, "copied text with quokka near kim@y.org in all of its copies") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(corpus):
    found = {r.doc_id: r for r in personal_data(corpus).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}

    def terms(i):
        return [(s.kind, texts[i][s.start : s.end]) for s in found[i].spans if s.kind > 3]

    assert (5, "Zanzibor") in terms(3)
    assert terms(200) == [(5, "Zanzibor")], "also where the entity is not named"
    assert terms(120) == [], "common words reveal nothing"
    assert terms(310) == [], "copies are one context"
    loose = personal_data(corpus, rules=Disclosure(support=100)).where("size(spans) > 0")
    assert all(s.kind < 4 for r in loose.collect() for s in r.spans)


def test_sanitised_texts(corpus):
    texts = {r.doc_id: r.text for r in sanitise(corpus).collect()}
    assert "jo@x.org" not in texts[2] and "<EMAIL>" in texts[2] and "Zanzibor" not in texts[2]
    assert texts[200] == "nobody but , knows this"
    assert texts[120] == "plain text 20 of the day about item 20"


def test_digest(spark):
    from featloom.llm.queries import QUERIES

    rows = QUERIES["op6_disclosure"](spark, FOLDER).collect()
    for r in rows:
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("term"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_rare_entities_are_disclosed_too(spark):
    """An entity of three documents, and a term that stands far from it in each of them."""
    far = " ".join(f"filler{i % 9}" for i in range(40))
    rows = [(i, f"Quillfeather {far} then number {i} of those who ask bo@z.org for more {i}") for i in range(3)]
    rows += [(100 + i, f"{far} then number {i} of those who ask for more") for i in range(40)]
    rows += [(200 + i, f"copy of Wombatson {far} written by al@z.org") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind > 3] for r in personal_data(docs).collect()}
    assert "Quillfeather" in found[1]
    assert not {"filler1", "then", "ask"} & set(found[1]), "common words reveal nothing"
    assert found[203] == [], "copies are one context"


def test_contexts_are_linear_in_spans():
    """Byte places and neighbouring words of many addresses, as found one by one; time grows with the text."""
    import time

    def context(n):
        text = " ".join(f"é word{i % 97} to user{i}@example.com and" for i in range(n))
        start = time.perf_counter()
        found = pii._contexts([text], [pii.find_spans(text)], 6)
        return time.perf_counter() - start, found

    small, found = context(2000)
    assert len(found[0][0]) == 2001
    large, _ = context(16_000)
    assert large < 24 * max(small, 0.02)
