from __future__ import annotations

import random
import re

from fixtures import FOLDER, awkward, empty

from featloom.llm import secrets
from featloom.llm.secrets import BASE, KINDS, REACH, linked_secrets

#: The base patterns in another form: labels by a flag, failing matches dropped after the search.
PLAIN = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
WHO, WHAT = ("access", "identifier"), ("assign", "hex", "credential")


def brute(text):
    text = text or ""
    base = [(m.start(), kind, m.end()) for kind, (p, g, least) in PLAIN.items() for m in p.finditer(text) if len(m[g]) >= least]
    weak, borders = [], []
    for m in re.finditer(secrets.WEAK, text):
        if m[0][0] == "\n":
            borders.append(m.start())
            continue
        mixed = all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))
        kind = (
            "endpoint" if re.match(secrets.ENDPOINT, m[0])
            else "identifier" if re.match(secrets.IDENTIFIER, m[0])
            else "credential" if mixed else None
        )
        if kind and not any(s < m.end() and e > m.start() for s, _, e in base):
            weak.append((m.start(), kind, m.end()))
    parts = base + weak
    scope = lambda at: sum(b <= at for b in borders)

    def near(part, kinds):
        return any(
            k in kinds and scope(s) == scope(part[0]) and (0 <= part[0] - e <= REACH or 0 <= s - part[2] <= REACH)
            for s, k, e in parts
        )

    for part in weak:
        needs = {"identifier": near(part, WHAT), "credential": near(part, (*WHO, "endpoint")), "endpoint": near(part, WHO) and near(part, WHAT)}
        if needs[part[1]]:
            base.append(part)
    return sorted((s, KINDS.index(k), e) for s, k, e in base)


def check(docs):
    found = {}
    for r in linked_secrets(docs).collect():
        found.setdefault(r.doc_id, []).append(([tuple(s) for s in r.spans], [r[f"n_{k}"] for k in BASE]))
    expected = {}
    for r in docs.collect():
        spans = brute(r.text)
        expected.setdefault(r.doc_id, []).append((spans, [sum(s[1] == i for s in spans) for i in range(len(BASE))]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    return found


def test_whole_table(spark):
    assert any(r for rows in check(spark.read.parquet(f"{FOLDER}/documents.parquet")).values() for r, _ in rows)


def test_awkward_rows(spark):
    check(awkward(spark))
    assert linked_secrets(empty(spark)).count() == 0


def test_parts_in_many_arrangements(spark):
    """Random texts of parts, at distances around the reach, across paragraphs, overlapping and repeated."""
    pick = random.Random(11)
    token = "Zx9" + "aB3dE5" * 4
    pieces = [
        "password: hunter2hunter2", "token = abc", "token: token: abcdefgh", 'API_KEY="x1y2z3w4"', "AKIA" + "Q7" * 9, "AKIA1",
        "0123456789abcdef" * 2, "user=alice", "login: 'bob", "client_id = 77", token, "https://db.example.com:5432/x",
        "é" * 7, "\n", "\n \n", " " * (REACH - 3), " " * REACH, " " * (REACH + 1), "x" * 30, f"secret={token}", "ſecret=abcdefgh", "𝄞 ",
    ]
    texts = ["".join(pick.choice(pieces) + pick.choice(["", " ", ","]) for _ in range(pick.randint(1, 14))) for _ in range(400)]
    found = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = {k for rows in found.values() for spans, _ in rows for _, k, _ in spans}
    assert kinds == set(range(len(KINDS)))


def test_weak_parts_need_each_other(spark):
    token = "Zx9" + "aB3dE5" * 4
    texts = [token, f"user=alice {token}", f"user=alice\n\n{token}", "see https://a.example/b", f"https://a.example/b {token} login=bob"]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [len(rows[i][0][0]) for i in range(5)] == [0, 2, 0, 0, 3]


def test_long_texts_and_equal_rows(spark):
    """Runs of a million characters, many matches in one text, and a row that a third of the table repeats."""
    texts = ["a" * 1_000_000, "\n" * 1_000_000, " " * 1_000_000, "password" + " " * 1_000_000, "f" * 1_000_000, "token=abcdef, " * 20_000]
    rows = linked_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [len(r.spans) for r in sorted(rows)] == [1, 0, 0, 0, 1, 20_000]
    one = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'user=bob token=abcdefgh' AS text")
    found = linked_secrets(one).select("spans").distinct().collect()
    assert [len(r.spans) for r in found] == [2]


def test_no_python_on_the_path(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    parts = secrets._parts(secrets._found(docs.selectExpr("doc_id AS key", "xxhash64(text) AS digest", "text")))
    plan = secrets._linked(parts)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
