from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from fixtures import FOLDER

from featloom.llm import trie
from featloom.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv long, family int"


def brute(rows):
    """Nodes by the definition: texts rebuilt, prefixes as dictionary keys."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(c - 100 * int(c / 100)), [])
        path = tuple(base[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        stack, leaves, saved = [path], 0, 0
        while stack:
            at = stack.pop()
            leaves += not children[at]
            saved += (len(members[at]) - 1) * len(at[-1][1]) if at else 0
            stack += children[at]
        return leaves, saved

    found = []
    for path, convs in members.items():
        leaves, saved = below(path)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        found.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves, saved, digest))
    return sorted(found, key=str)


def check(frame):
    rows = sorted((tuple(r) for r in prefix_trie(frame).collect()), key=str)
    assert rows == brute([tuple(r) for r in frame.collect()])
    return rows


def test_whole_table(spark):
    assert check(spark.read.parquet(f"{FOLDER}/conversations.parquet"))


def test_awkward_rows(spark):
    """Nulls, absent bases, negative ids, turnless conversations, long ones, repeated rows, clashing columns."""
    pick = random.Random(5)
    rows = []
    for conv in [*range(0, 40), *range(100, 103), *range(301, 320), -7, -100, -205, 9_000_000_000_000]:
        for turn in range(pick.choice([1, 2, 5, 9, 40])):
            text = pick.choice(["a", "b", "", None, "long é" * 50])
            rows.append((conv, None if turn == 0 else turn, pick.choice(["user", None, ""]), text))
    rows += [(400, 1, "user", "twice"), (400, 1, "user", "twice"), (None, 1, "user", "lost"), (405, None, None, None)]
    rows += [(600, t, "user", "z" * 100_000) for t in range(3)] + [(601, t, "user", "z" * 100_000) for t in range(9)]
    pick.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    found = check(frame)
    assert sum(r[1] == 0 for r in found) == 1
    assert prefix_trie(frame.limit(0)).count() == 0


def test_state_crosses_batches(spark):
    """Every batch of one row, and two rows, gives what one batch gives."""
    frame = spark.read.parquet(f"{FOLDER}/conversations.parquet").where("conv_id < 300")
    whole = sorted(map(tuple, prefix_trie(frame).collect()), key=str)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("1", "2", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert sorted(map(tuple, prefix_trie(frame).collect()), key=str) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_many_copies_of_one_conversation(spark):
    frame = spark.sql(
        "SELECT id AS conv_id, t AS turn, 'user' AS role, concat('turn ', t) AS text "
        "FROM range(3000) LATERAL VIEW explode(sequence(0, 6)) AS t"
    )
    rows = check(frame)
    assert len(rows) == 8
    assert {r[3] for r in rows} == {3000}


def test_fingerprints_compose():
    """A product of heads and suffixes equals the product over the rebuilt turns."""
    assert trie._power(3, trie.np.array([0, 1, 5, 70])).tolist() == [pow(3, n, 1 << 64) for n in (0, 1, 5, 70)]
