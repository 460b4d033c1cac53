from __future__ import annotations

from collections import Counter

import pytest
from fixtures import FOLDER, awkward, empty, words

from featloom.llm.quality import LineRules, clean_documents, line_frequency_rules


def base(text):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = set()
    for i in range(len(found) - 4):
        if windows[tuple(found[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, again = len(found), len(covered)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, again, n < 10 or 100 * again > 20 * n


def check(docs):
    got = line_frequency_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    ours = sorted((str(r.doc_id), *(r[n] for n in names)) for r in got)
    assert ours == sorted((str(r.doc_id), *base(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in got)


def test_base_of_all_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_awkward_rows(spark):
    check(awkward(spark))
    assert line_frequency_rules(empty(spark)).count() == 0
    assert clean_documents(empty(spark)).columns == empty(spark).columns


@pytest.fixture
def hosts(spark):
    own = "document {} tells about its very own subject in words that nobody else has {}"
    rows = [(i, f"Subscribe to OUR  newsletter\n{own.format(i, i * i)}\nMore {i}", "en", "a") for i in range(30)]
    rows += [(100 + i, f"subscribe to our newsletter\n{'tiny' if i else own.format(1, 2)}", "en", "a") for i in range(5)]
    rows += [(200 + i, f"Subscribe to our newsletter\n{own.format(i, 7)}", "en", "b") for i in range(5)]
    rows += [(300 + i, f"first line of a copied document, {'long ' * 3}\nsecond line of it is here too", "en", "a") for i in range(40)]
    return spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_lines_of_many_documents_go_and_depleted_documents_too(hosts):
    verdicts = {r.doc_id: r for r in line_frequency_rules(hosts).collect()}
    assert all(verdicts[i].kept and verdicts[i].boilerplate_words == 4 for i in range(30))
    assert not any(verdicts[100 + i].kept for i in range(1, 5))
    assert all(verdicts[200 + i].boilerplate_words == 0 for i in range(5)), "below the limit in host b"
    assert all(verdicts[300 + i].kept for i in range(40)), "copies are no boilerplate"


def test_cleaned_documents(hosts):
    cleaned = {r.doc_id: r for r in clean_documents(hosts).collect()}
    assert 101 not in cleaned and len(cleaned) == 30 + 1 + 5 + 40
    assert "newsletter" not in cleaned[7].text and cleaned[7].text.endswith("More 7")
    assert cleaned[7].n_chars == len(cleaned[7].text)
    assert "newsletter" in cleaned[203].text


def test_limits_are_parameters(hosts):
    loose = line_frequency_rules(hosts, rules=LineRules(max_docs=1000))
    assert loose.where("boilerplate_words > 0").count() == 0


FOOTER = ["All rights reserved by the owners", "Read our terms of use", "Contact us by mail", "Follow us on every network"]


def judge(rows, rules):
    """Kept documents by brute force, over (doc_id, text, host)."""

    def lines(text):
        return {tuple(words("".join(c.lower() if "A" <= c <= "Z" else c for c in x))) for x in text.split("\n") if words(x)}

    def size(text, among):
        found = [tuple(words("".join(c.lower() if "A" <= c <= "Z" else c for c in x))) for x in text.split("\n")]
        return sum(len(x) for x in found if x in among)

    kept = {}
    for host in {r[2] for r in rows}:
        texts = {r[1] for r in rows if r[2] == host}

        def above(docs, allowed=None):
            counts = Counter(x for t in docs for x in lines(t) if allowed is None or x in allowed)
            return {x for x, n in counts.items() if n > rules.max_docs and n > rules.max_share * len(texts)}

        frequent = above(texts)
        own = [t for t in texts if len(words(t)) - size(t, frequent) >= rules.min_own * len(words(t))]
        bad = above(own, frequent)
        for doc_id, text, of in rows:
            if of == host:
                n = len(words(text))
                kept[doc_id] = not base(text)[-1] and n - size(text, bad) >= rules.min_left * n
    return kept


def test_footer_of_several_lines_goes_and_copies_stay(spark):
    own = "document {} tells about its very own subject in words that nobody else has {}"
    footer = "\n".join(FOOTER)
    body = "\n".join(" ".join(f"word{i}of{j}" for j in range(10)) for i in range(40))
    rows = [(i, f"{own.format(i, i * i)}\n{footer}", "a") for i in range(500)]
    rows += [(1000 + i, f"own {i}\n{footer}", "a") for i in range(50)]
    rows += [(2000 + i, f"{body}\n{FOOTER[0]}", "a") for i in range(3000)]
    rows += [(6000 + i, f"{body}\nand a change for number {i}", "a") for i in range(200)]
    rows += [(7000 + i, f"{own.format(i, 'b')}\n{footer}", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency_rules(docs).collect()}
    assert all(len(got[i].boilerplate) == 4 and got[i].kept for i in range(500))
    assert not any(got[1000 + i].kept for i in range(50)), "nothing beside the footer"
    assert all(got[2000 + i].kept and got[2000 + i].boilerplate_words == 6 for i in range(3000))
    assert all(got[6000 + i].kept and got[6000 + i].boilerplate_words == 0 for i in range(200))
    assert all(got[7000 + i].boilerplate_words == 0 for i in range(20)), "not above the limit"
    assert {i: r.kept for i, r in got.items()} == judge(rows, LineRules())


@pytest.mark.parametrize("rules", [LineRules(), LineRules(max_docs=2, max_share=0.0), LineRules(max_docs=5, min_own=0.0)])
def test_verdicts_of_all_documents(spark, rules):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    assert {r.doc_id: r.kept for r in line_frequency_rules(docs, rules=rules).collect()} == judge(rows, rules)
