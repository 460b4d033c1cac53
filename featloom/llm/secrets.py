"""Secret scan: multipart credentials, linked by an interval join of their parts.

Labelled values, access keys and hexadecimal runs are reported wherever they stand.  Weaker
parts (account identifiers, unlabelled tokens, endpoints) say nothing alone: they are reported
if parts that complete them stand within reach in the same scope, a paragraph.  Everything is
DataFrame functions: a pattern splits a text, and running sums of the lengths of its pieces
are the positions of its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.plans.storage import materialise, release


def _either(word: str) -> str:
    """A pattern for ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns, in the order of their kinds, and the least length of what counts.
_LABELS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"(?:{_LABELS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE = {"assign": (ASSIGN, 1, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}

#: Weak parts and the blank lines between scopes, as one pattern: its matches never overlap.
_OWNERS = "|".join(map(_either, ("user_?name", "user_?id", "user", "login", "account", "client_?id", "access_?key_?id")))
IDENTIFIER = rf"(?:{_OWNERS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+/_.-]+"
_SCHEMES = "|".join("https ftps ftp ssh jdbc postgresql postgres mysql mongodb redis amqps amqp s3 http".split())
ENDPOINT = rf"(?:{_SCHEMES})://[^\x00-\x20\"'<>\x7F]+"
CREDENTIAL = r"[A-Za-z0-9+/_-]{20,}"
BORDER = r"\n[\x20\t\r]*\n"
WEAK = f"{ENDPOINT}|{IDENTIFIER}|{CREDENTIAL}|{BORDER}"

#: Kinds in the order in which equal positions are listed.
KINDS = [*BASE, "identifier", "credential", "endpoint"]
#: What a part is in a credential: who, the secret itself, or where it opens a door.
ROLES = {"access": "who", "identifier": "who", "assign": "what", "hex": "what", "credential": "what", "endpoint": "where"}
#: Code points between two parts of one credential at most.
REACH = 200


def _teller(kind: str, least: int):
    """What is kept of a match of some pattern."""

    def told(match: Column, number: Column) -> Column:
        whole, name = match["whole"], F.lit(kind)
        if kind == "weak":
            mixed = whole.rlike("[0-9]") & whole.rlike("[A-Z]") & whole.rlike("[a-z]")
            name = (
                F.when(whole.startswith("\n"), "border")
                .when(whole.rlike(f"^(?:{ENDPOINT})"), "endpoint")
                .when(whole.rlike(f"^(?:{IDENTIFIER})"), "identifier")
                .when(mixed, "credential")
            )
        return F.struct(
            F.lit(kind).alias("pattern"),
            number.alias("number"),
            F.length(match["gap"]).alias("gap"),
            F.length(whole).alias("length"),
            F.when(F.length(match["value"]) >= least, name).alias("kind"),
        )

    return told


def _found(rows: DataFrame) -> DataFrame:
    """One row per match: key, pattern, number, gap before it, length, whether it counts, kind."""
    lists = []
    for kind, (pattern, group, least) in {**BASE, "weak": (WEAK, 0, 0)}.items():
        # the text between matches has one piece more than there are matches, which holds no match
        columns = [
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
            F.split("text", pattern, -1).alias("gap"),
        ]
        lists.append(F.transform(F.arrays_zip(*columns), _teller(kind, least)))
    rows = rows.select("key", "digest", F.concat(*lists).alias("found"))
    # not as filters: those would be moved to the scan, and all patterns searched again
    telling = F.exists("found", lambda f: f["kind"].isNotNull() & (f["kind"] != "border"))
    rows = rows.select("key", "digest", F.when(telling, F.col("found")).alias("found"))
    rows = rows.select("key", "digest", F.explode_outer("found").alias("f")).select("key", "digest", "f.*").where("length IS NOT NULL")
    # equal rows have equal matches: one of each goes on, before the shuffle
    return rows.groupBy("key", "digest", "pattern", "number").agg(*(F.first(c).alias(c) for c in ("gap", "length", "kind")))


def _parts(found: DataFrame) -> DataFrame:
    """Positions of all matches that count, the scope they stand in, weak ones only beside base spans."""
    so_far = Window.partitionBy("key", "digest", "pattern").orderBy("number")
    end = F.sum((F.col("gap") + F.col("length")).cast("long")).over(so_far)
    rows = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).where("kind IS NOT NULL")
    here = Window.partitionBy("key", "digest").orderBy("start")
    base = F.col("kind").isin(*BASE)
    before = here.rangeBetween(Window.unboundedPreceding, 0)
    behind = here.rangeBetween(0, Window.unboundedFollowing)
    rows = rows.select(
        "key",
        "digest",
        "kind",
        "start",
        "end",
        F.sum((F.col("kind") == "border").cast("long")).over(before).alias("scope"),
        F.max(F.when(base, F.col("end"))).over(before).alias("covered"),
        F.min(F.when(base, F.col("start"))).over(behind).alias("next"),
    )
    free = (F.coalesce("covered", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return rows.where((F.col("kind") != "border") & (base | free)).drop("covered", "next")


def _linked(parts: DataFrame) -> DataFrame:
    """Weak parts that parts of other roles complete within reach: an interval join.

    Bins are as wide as the reach, so what may complete a part ends in the bin where it starts or
    in the one before, or starts in the bin where it ends or in the next.  A bin holds one row
    with the extremes per role, which decide each interval exactly; pairs are never made.
    """
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.col("kind")]
    scope = ["key", "digest", "scope"]
    sides = F.explode(F.array(F.struct(F.lit("end").alias("side"), F.col("end").alias("at")), F.struct(F.lit("start").alias("side"), F.col("start").alias("at"))))
    points = parts.select(*scope, role.alias("role"), sides.alias("p")).select(*scope, "role", "p.*")
    extremes = [
        f(F.when(F.col("role") == r, F.col("at"))).alias(f"{name} {r}")
        for r in ("who", "what", "where")
        for f, name in ((F.min, "low"), (F.max, "high"))
    ]
    bins = points.groupBy(*scope, "side", F.floor(F.col("at") / REACH).alias("bin")).agg(*extremes)

    weak = parts.where(~F.col("kind").isin(*BASE))

    def probe(side, at, step, low, high):
        return F.struct(F.lit(side).alias("side"), (F.floor(at / REACH) + step).alias("bin"), low.alias("low"), high.alias("high"))

    start, end = F.col("start"), F.col("end")
    probes = [probe("end", start, s, start - REACH, start) for s in (0, -1)]
    probes += [probe("start", end, s, end, end + REACH) for s in (0, 1)]
    asked = weak.select("*", F.explode(F.array(*probes)).alias("p")).select(*weak.columns, "p.*").alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "key" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*scope, "side", "bin"]]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    met = asked.join(bins.alias("b"), condition)
    has = [
        F.bool_or((F.col(f"b.`low {r}`") <= F.col("a.high")) & (F.col(f"b.`high {r}`") >= F.col("a.low"))).alias(r)
        for r in ("who", "what", "where")
    ]
    columns = [F.col(f"a.{c}").alias(c) for c in parts.columns]
    met = met.groupBy(*columns).agg(*has)
    complete = F.expr(
        "CASE kind WHEN 'identifier' THEN what WHEN 'credential' THEN who OR where ELSE who AND what END"
    )
    return met.where(complete).select(*parts.columns)


def linked_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every text: base spans, and weak parts of credentials that complete each other.

    An identifier needs a secret within ``REACH`` code points of its paragraph, an unlabelled token
    (20 characters or more, with digits, capitals and small letters) an identifier or endpoint, an
    endpoint both of the others.  Weak parts that overlap a base span are part of it.

    Returns one row per row: the key, ``n_assign``, ``n_access``, ``n_hex`` and ``spans``, an array of
    (start, kind as a place in ``KINDS``, end) in code points, in order.  Null text is empty, null
    keys are a key like others, equal rows have equal results, an empty table gives an empty
    result; other columns are not read.

    Texts stay where they are read: only positions are shuffled, by key and a digest of the text, so
    documents that share a key do not mix.  Work grows with the matches of a text, not with their
    pairs; the matches of one text are one group, as the text is one row.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("digest"), body.alias("text"))
    parts = materialise(_parts(_found(rows)), "secret-parts")
    spans = parts.where(F.col("kind").isin(*BASE)).unionByName(_linked(parts))
    place = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    listed = F.array_sort(F.collect_list(F.struct("start", place.alias("kind"), "end")))
    spans = spans.groupBy("key", "digest").agg(listed.alias("spans")).alias("s")
    every = rows.select("key", "digest").alias("r")
    same = F.col("r.key").eqNullSafe(F.col("s.key")) & (F.col("r.digest") == F.col("s.digest"))
    spans_or_none = F.coalesce(F.col("s.spans"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = every.join(spans, same, "left").select(F.col("r.key").alias(key), spans_or_none.alias("spans"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    result = materialise(joined.select(f"`{key}`", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), "spans"), "secrets")
    release(parts)
    return result


def listed(spans: Column, *, base: bool) -> Column:
    """``kind:start:end``, joined by commas: base spans only, or all."""
    names = F.array(*(F.lit(k) for k in KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < len(BASE)) if base else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
