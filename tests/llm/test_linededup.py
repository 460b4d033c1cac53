from __future__ import annotations

import random
from collections import defaultdict

from fixtures import FOLDER, awkward, empty, words

from featloom.llm.linededup import MIN_WORDS, dedup_lines


def normal(line):
    return tuple(words("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def brute(rows):
    """Lines to remove, from all strings with one word deleted."""
    texts = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows})
    # equal ids are ordered by a hash of the text, which the callers avoid to depend on
    where = defaultdict(list)
    for d, (null, key, text) in enumerate(texts):
        for number, line in enumerate(text.split("\n")):
            if normal(line):
                where[normal(line)].append((null, key, d, number))
    first = {line: min(places) for line, places in where.items()}
    replaced, deleted = defaultdict(list), defaultdict(list)
    for line in where:
        if len(line) >= MIN_WORDS:
            for i in range(len(line)):
                short = line[:i] + line[i + 1 :]
                replaced[i, short].append(line)
                if len(short) >= MIN_WORDS and short in where:
                    deleted[line].append(short)
    near = set()
    for group in replaced.values():
        near |= {line for line in group if first[line] > min(first[x] for x in group)}
    for line, shorts in deleted.items():
        for short in shorts:
            near.add(max(line, short, key=first.get))
    gone = defaultdict(set)
    for line, places in where.items():
        for place in places:
            if line in near or place != first[line]:
                gone[texts[place[2]]].add(place[3])
    return gone


def check(docs):
    rows = docs.collect()
    gone = brute(rows)
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows)
    wanted = sorted(
        (str(r.doc_id), str(kept_text(r, drop)), sorted(drop))
        for r in rows
        for drop in [gone[r.doc_id is None, r.doc_id or 0, r.text or ""]]
    )
    assert sorted((str(r.doc_id), str(r.text), list(r.removed_lines)) for r in got) == wanted
    return got


def kept_text(row, drop):
    if row.text is None:
        return None
    return "\n".join(x for i, x in enumerate(row.text.split("\n")) if i not in drop)


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert sum(len(r.removed_lines) for r in got) > 100


def test_awkward_rows(spark):
    docs = awkward(spark).where("doc_id IS NOT NULL OR text IS NOT NULL")
    got = check(docs)
    assert [c for c in dedup_lines(docs).columns if c != "removed_lines"] == docs.columns
    assert all(r.n_chars == len(r.text or '') for r in got)
    assert dedup_lines(empty(spark)).count() == 0


def test_edits_of_every_kind_at_every_place(spark):
    draw = random.Random(2)
    fresh = iter(f"w{i}" for i in range(10**6))
    rows = []
    for group in range(60):
        line = [next(fresh) for _ in range(draw.choice([7, 8, 9, 15, 16, 40, 41, 64]))]
        rows.append(" ".join(line))
        for _ in range(6):
            edited = list(line)
            for _ in range(draw.choice([1, 1, 2])):
                at = draw.randrange(len(edited))
                kind = draw.choice("sid")
                if kind == "s":
                    edited[at] = next(fresh)
                elif kind == "i":
                    edited.insert(at, draw.choice([next(fresh), edited[at]]))
                else:
                    del edited[at]
            rows.append(" ".join(edited))
            if draw.random() < 0.4:
                line = edited  # a chain
    draw.shuffle(rows)
    texts = [(i, "\n".join(rows[7 * i : 7 * i + 7])) for i in range(60)]
    got = check(spark.createDataFrame(texts, "doc_id long, text string"))
    assert 150 < sum(len(r.removed_lines) for r in got) < 400


def test_many_variants_of_one_line(spark):
    base = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: i % 30], f"x{i}", *base[i % 30 + 1 :]])) for i in range(600)]
    rows.append((10_000, " ".join(base)))
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(not r.removed_lines for r in got) == 30, "each place has an earliest variant; the base comes last"
