"""Conversation prefix trie: composable monoid fingerprints of rebuilt conversations.

A sequence of turns has the fingerprint ``V(t1..tn) = V(t1..tn-1) * B + t`` over 64-bit numbers,
in two lanes with bases of their own.  With the length these are elements of a monoid:
``(m, U) . (n, W) = (m + n, U * B**n + W)``, and a prefix can be taken off again.  So the nodes of
a conversation that takes its head from a base conversation follow from the head's element and
the products of its own suffix; no rebuilt text exists anywhere, and only digests, lengths and
references are shuffled.  Equality is verified: equal digests must be equal stored turns, and all
members of a node must agree in their last turn and in their parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.llm.words import powers
from featloom.plans.skew import split_left_join
from featloom.plans.storage import materialise, release

#: Turns that a conversation may take from its base: 0 to HEAD - 1 (by checksum).
HEAD = 6
#: Conversations whose numbers agree but for the last two digits share a base.
FAMILY = 100
#: Bases of the two lanes: odd, and 3 modulo 4.
LANES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
#: Ids whose lists are joined as one piece have the same number but for these bits.
ID_BITS = 9

_INVERSES = tuple(pow(base, -1, 1 << 64) for base in LANES)
_MEMBERS = "conv long, depth int, f1 long, f2 long, p1 long, p2 long, t1 long, t2 long, length long, ends boolean"


@dataclass
class _Carry:
    """What the rows of a partition leave to those after them: constant in size."""

    family: int | None = None
    conv: int | None = None
    position: int = 0
    value: np.ndarray = field(default_factory=lambda: np.zeros(2, np.uint64))
    at_head: np.ndarray = field(default_factory=lambda: np.zeros(2, np.uint64))
    base_turns: int = 0
    heads: np.ndarray = field(default_factory=lambda: np.zeros((2, HEAD), np.uint64))  # V of the base
    turns: np.ndarray = field(default_factory=lambda: np.zeros((2, HEAD), np.uint64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(HEAD, np.int64))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every rebuilt conversation, one row for each depth.

    Rows come by family (its base first), conversation and turn.  The last row waits for the
    next batch, which tells whether its conversation goes on.
    """
    carry, waiting = _Carry(), None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        waiting = table.slice(table.num_rows - 1)
        if table.num_rows > 1:
            yield _advance(carry, table.slice(0, table.num_rows - 1), waiting.column("conv")[0].as_py())
    if waiting is not None:
        yield _advance(carry, waiting, None)


def _advance(carry: _Carry, table: pa.Table, following: int | None) -> pa.RecordBatch:
    column = lambda name: table.column(name).to_numpy()
    family, conv, head, length = column("family"), column("conv"), column("head"), column("length")
    turn = [column(name).astype(np.int64).view(np.uint64) for name in ("t1", "t2")]
    count, at = len(conv), np.arange(len(conv))
    new = np.append(conv[0] != carry.conv, conv[1:] != conv[:-1])
    goes_on, same_family = not new[0], family[0] == carry.family
    last = np.append(conv[1:] != conv[:-1], conv[-1] != following)
    new[0] = True
    starts, part = np.flatnonzero(new), np.cumsum(new) - 1
    position = at - starts[part] + 1
    if goes_on:
        position[part == 0] += carry.position

    new_family = np.append(True, family[1:] != family[:-1])
    group = np.cumsum(new_family) - 1
    groups, parts = group[-1] + 1, len(starts)
    is_base = conv == family
    heads, turns = (np.zeros((2, groups, HEAD), np.uint64) for _ in range(2))
    lengths, base_turns = np.zeros((groups, HEAD), np.int64), np.zeros(groups, np.int64)
    if same_family:
        heads[:, 0], turns[:, 0], lengths[0], base_turns[0] = carry.heads, carry.turns, carry.lengths, carry.base_turns
    value, at_head = np.zeros((2, count), np.uint64), np.zeros((2, parts), np.uint64)
    opening = np.flatnonzero(is_base & (position < HEAD))
    reached = np.flatnonzero(position == head)
    for lane, base in enumerate(LANES):
        up, down = powers(base, count + 1), powers(_INVERSES[lane], count)
        sums = np.cumsum(turn[lane] * down)
        before = np.append(np.uint64(0), sums)[starts]
        value[lane] = up[:-1] * (sums - before[part])
        if goes_on:
            mine = part == 0
            value[lane][mine] += carry.value[lane] * up[1:][mine]
            at_head[lane, 0] = carry.at_head[lane]
        at_head[lane, part[reached]] = value[lane][reached]
        heads[lane, group[opening], position[opening]] = value[lane][opening]
        turns[lane, group[opening], position[opening]] = turn[lane][opening]
    lengths[group[opening], position[opening]] = length[opening]
    np.maximum.at(base_turns, group[opening], position[opening])

    taken = np.where(is_base, 0, np.minimum(head, base_turns[group]))
    own = np.flatnonzero(is_base | (position > head))
    # the head is told once: before the first turn of the suffix, or at the end if there is none
    event = np.flatnonzero(np.where(is_base, position == 1, (position == head + 1) | (last & (position <= head))))
    bare = last[event] & (position[event] <= head[event]) & ~is_base[event]
    repeat = taken[event]
    again = np.repeat(np.arange(len(event)), repeat)
    level = np.arange(len(again)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + 1
    of = group[event][again]
    root = np.zeros(len(event), np.uint64)
    found = {
        "conv": [conv[own], conv[event][again], conv[event]],
        "depth": [np.where(is_base[own], position[own], taken[own] + position[own] - head[own]), level, repeat * 0],
        "length": [length[own], lengths[of, level], repeat * 0],
        "ends": [last[own], bare[again] & (level == repeat[again]), bare & (repeat == 0)],
    }
    beyond = np.where(is_base[own], 0, position[own] - head[own])
    for lane, base in enumerate(LANES):
        suffix = value[lane][own]
        power = _power(base, beyond)
        composed = heads[lane, group[own], taken[own]] * power + suffix - at_head[lane, part[own]] * power
        composed = np.where(is_base[own], suffix, composed)
        name = lane + 1
        parent = (composed - turn[lane][own]) * np.uint64(_INVERSES[lane])
        found[f"f{name}"] = [composed, heads[lane, of, level], root]
        found[f"p{name}"] = [parent, heads[lane, of, level - 1], root]
        found[f"t{name}"] = [turn[lane][own], turns[lane, of, level], root]

    end = count - 1
    carry.family, carry.conv, carry.position = int(family[end]), int(conv[end]), int(position[end])
    carry.value, carry.at_head = value[:, end].copy(), at_head[:, -1].copy()
    carry.heads, carry.turns = heads[:, -1].copy(), turns[:, -1].copy()
    carry.lengths, carry.base_turns = lengths[-1].copy(), int(base_turns[-1])

    joined = {name: np.concatenate(pieces) for name, pieces in found.items()}
    types = {"depth": pa.int32(), "ends": pa.bool_()}
    order = [f.split()[0] for f in _MEMBERS.split(", ")]
    arrays = [
        pa.array(joined[n].view(np.int64) if joined[n].dtype == np.uint64 else joined[n]).cast(types.get(n, pa.int64()))
        for n in order
    ]
    return pa.RecordBatch.from_arrays(arrays, order)


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2**64 by squaring, for exponents of any size."""
    result, square, rest = np.ones(len(exponents), np.uint64), base, exponents.copy()
    while rest.any():
        result = np.where(rest & 1, result * np.uint64(square), result)
        square, rest = square * square % (1 << 64), rest >> 1
    return result


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which follow each other; one piece in memory at a time."""
    key, running, names = None, None, ["depth", "f1", "f2"]

    def told(rows):
        columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*names, "ends_sha256"])

    for batch in batches:
        done = []
        for *this, piece in zip(*(batch.column(n).to_pylist() for n in [*names, "piece"])):
            if this != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = this, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield told(done)
    if key is not None:
        yield told([(*key, running.hexdigest())])


def _verify(turns: DataFrame) -> None:
    """Equal digests must stand for equal stored turns; partial minima and maxima are shuffled."""
    body = F.struct("role", "text")
    seen = turns.groupBy("t1", "t2").agg(F.min(body).alias("low"), F.max(body).alias("high"))
    if seen.where("low <> high").select("t1").first() is not None:
        raise ArithmeticError("two different turns have one digest of 128 bits")


def prefix_trie(
    conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node.

    A conversation ``c`` is rebuilt from the first ``h`` turns of conversation ``c - c % 100`` (all
    if it has fewer, none if it is absent) and its own turns behind its first ``h``, where ``h`` is
    the unsigned CRC-32 of its decimal number modulo 6.  A node is a distinct sequence of first
    turns; all rebuilt conversations that begin with it are its members, from the root on.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (over the subtree) and ``ends_sha256`` (of the members that end
    here).  The sum over a subtree is taken over its members: what a node holds is told by its
    smallest member, at its depth, so no tree is walked and no pair of nodes is made.

    One shuffle brings families of conversations together by digests; sorted rows stream through
    a state of fixed size, however long a conversation is.  Counts are pre-aggregated; parents
    with very many children are joined apart.  Rows without a conversation id belong to none.
    Null roles and texts are empty, null turns come first, equal turn numbers by digest; repeated
    rows are turns of their own; an empty table has no node; other columns are not read.
    """
    name = lambda column: F.col(f"`{column}`")
    blank = F.lit("")
    stored = conversations.where(name(conv).isNotNull()).select(
        name(conv).cast("long").alias("conv"),
        name(turn).alias("turn"),
        F.coalesce(name(role), blank).alias("role"),
        F.coalesce(name(text), blank).alias("text"),
    )
    stored = stored.withColumn("t1", F.xxhash64("role", "text")).withColumn("t2", F.xxhash64(F.lit("turn"), "text", "role"))
    _verify(stored)
    family = F.col("conv") - F.col("conv") % FAMILY
    rows = stored.select(
        family.alias("family"),
        (F.col("conv") != family).alias("member"),
        "conv",
        "turn",
        "t1",
        "t2",
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).alias("head"),
        F.length("text").cast("long").alias("length"),
    )
    order = ["family", "member", "conv", F.col("turn").asc_nulls_first(), "t1", "t2"]
    rows = rows.repartition("family").sortWithinPartitions(*order).drop("member", "turn")
    members = materialise(rows.mapInArrow(_members, _MEMBERS), "trie-members")

    node = ["depth", "f1", "f2"]
    held = members.groupBy(*node).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("length").alias("length"), F.sum(F.col("ends").cast("long")).alias("ended")
    )
    told = held.select(
        "conv",
        "depth",
        ((F.col("n") - 1) * F.col("length")).alias("saved"),
        (F.col("ended") == F.col("n")).cast("long").alias("leaf"),
        F.lit(1).alias("told"),
    )
    events = members.unionByName(told, allowMissingColumns=True)
    below = Window.partitionBy("conv").orderBy(F.col("depth").desc())
    events = events.select(
        *members.columns,
        "told",
        F.sum("saved").over(below).alias("saved"),
        F.sum("leaf").over(below).alias("leaves"),
        F.sum("told").over(below.rangeBetween(-1, -1)).alias("children"),
    )
    events = events.where("told IS NULL")

    alike = [F.min(c) == F.max(c) for c in ("t1", "t2", "p1", "p2", "length")]
    sound = alike[0]
    for part in alike[1:]:
        sound = sound & part
    nodes = events.groupBy(*node).agg(
        F.min("conv").alias("conv_id"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.when(sound, F.count("*")).otherwise(F.raise_error(F.lit("two sequences of turns have one fingerprint"))).alias("n_convs"),
        F.coalesce(F.sum("children"), F.lit(0)).cast("long").alias("n_children"),
        F.coalesce(F.sum("leaves"), F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).cast("long").alias("saved_tokens"),
    )
    nodes = materialise(nodes, "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    placed = split_left_join(nodes, above, ["depth", "p1", "p2"])

    block = F.shiftright("conv", ID_BITS).alias("block")
    pieces = members.where("ends").groupBy(*node, block).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select(*node, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("piece"))
    pieces = pieces.repartition(*node).sortWithinPartitions(*node, "block").drop("block")
    ends = pieces.mapInArrow(_digests, "depth int, f1 long, f2 long, ends_sha256 string")
    result = placed.join(ends, node, "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    result = materialise(result, "trie")
    release(members, nodes)
    return result
