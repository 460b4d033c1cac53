"""The registered queries of the training-data operators, with oracle SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import secrets
from featloom.llm.divergence import source_divergence
from featloom.llm.html import extract_text, learn_weights
from featloom.llm.lattice import embedding_groups
from featloom.llm.linededup import dedup_lines
from featloom.llm.lmscore import score_corpus
from featloom.llm.minhash import minhash_groups
from featloom.llm.mixing import mixing_plan
from featloom.llm.packing import pack_documents
from featloom.llm.pii import personal_data
from featloom.llm.quality import line_frequency_rules
from featloom.llm.sharding import shard_records
from featloom.llm.trie import prefix_trie
from featloom.plans.storage import materialise

#: Labelled ids, 8 bytes each, that are broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 21

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def vocabulary() -> str:
    """The byte-level vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored against those that are labelled good and not toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")  # other columns may have any name
    good = F.max((F.col("quality") == 1) & (F.col("toxic") == 0))
    good = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(good.alias("good")).where("good")
    ids = good.select(F.col("labelled").cast("long"))
    few = ids.count() <= BROADCAST_IDS
    flagged = docs.join(F.broadcast(ids) if few else ids.hint("merge"), F.col("doc_id") == F.col("labelled"), "left")
    flagged = flagged.select("doc_id", "text", F.col("labelled").isNotNull().alias("good"))
    return score_corpus(flagged if few else materialise(flagged, "flagged"), target="good")


@query
def op2_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without duplicate lines: which lines went, and what the text is now."""
    docs = dedup_lines(read(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.concat_ws(",", "removed_lines").alias("removed_lines"),
        "n_chars",
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


@query
def op3_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of one label at cosine 0.98."""
    return embedding_groups(read(spark, sf_dir, "embeddings"), least=0.98)


ORACLES["op3_e8_lattice"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, p.y FROM reach r JOIN pairs p ON r.to_id = p.x
), c AS (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id
), n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n ON n.x = e.vec_id
"""


@query
def op4_maximum_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, with weights from the pages that mark their article."""
    pages = read(spark, sf_dir, "pages")
    return extract_text(pages, learn_weights(pages))


ORACLES["op4_maximum_subsequence"] = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1)[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS parts
  FROM a
), c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&amp;', '&'),
    '[ 	-
]+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM b
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM c
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, no source more than twice."""
    plan = mixing_plan(read(spark, sf_dir, "documents"), [3.0, 1.0, 2.0], budget=1.5, max_epochs=2.0)
    return plan.select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken")


ORACLES["op5_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || md5(concat_ws(':', doc_id, md5(coalesce(text, ''))) || ':mix1')[1:13] AS BIGINT) / 4503599627370496.0 AS u
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source
), w AS (
  SELECT source, n, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), o AS (
  SELECT *, row_number() OVER a AS k, sum(2 * n) OVER a AS caps, sum(w) OVER b AS rest, sum(n) OVER () AS total
  FROM w WINDOW a AS (ORDER BY 2 * n / w, source ROWS UNBOUNDED PRECEDING),
    b AS (ORDER BY 2 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (SELECT min_by((1.5 * total - (caps - 2 * n)) / rest, k) FILTER ((1.5 * total - (caps - 2 * n)) / rest <= 2 * n / w) AS level FROM o
), r AS (SELECT source, n, least(2 * n, level * w) AS target FROM w, l)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT d.*, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
"""


@query
def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of all documents."""
    found = personal_data(read(spark, sf_dir, "documents"))
    terms = F.expr("transform(filter(spans, s -> s.kind > 3), s -> concat_ws(':', 'term', s.start, s.end))")
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), terms).alias("spans"),
    )


@query
def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, five-word shingles, similarity 0.85."""
    return minhash_groups(read(spark, sf_dir, "documents"), percent=85).drop("content")


@query
def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents; a source is a host."""
    rules = line_frequency_rules(read(spark, sf_dir, "documents"))
    return rules.withColumn("n_boilerplate_lines", F.size("boilerplate").cast("long")).drop("boilerplate")


@query
def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    pieces = pack_documents(read(spark, sf_dir, "documents"), vocabulary(), window=1024, end_id=0)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").cast("long").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal weight, and in nine."""
    shards = shard_records(read(spark, sf_dir, "documents"), [1.0] * 8, grown=[1.0] * 9)
    return shards.withColumn("law", F.lit("key"))


@query
def op11_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, and weak parts of credentials that complete each other."""
    found = secrets.linked_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(f"n_{kind}" for kind in secrets.BASE),
        F.sha2(F.encode(secrets.listed(F.col("spans"), base=True), "UTF-8"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans"), base=False).alias("spans"),
    )


def _matches(kind: str, pattern: str, group: int) -> str:
    """SQL for the matches of a pattern: text between matches and running lengths give positions."""
    pattern = pattern.replace("'", "''")
    return f"""
SELECT id, k, whole, value, CAST(sum(gap + length(whole)) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS e
FROM (SELECT id, '{kind}' AS k, i, w[i] AS whole, v[i] AS value, length(g[i]) AS gap FROM (
  SELECT id, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS v,
    string_split_regex(t, '{pattern}') AS g, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d))"""


def _secrets_sql() -> str:
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, (_, _, n) in secrets.BASE.items())
    base = " UNION ALL ".join(_matches(kind, pattern, group) for kind, (pattern, group, _) in secrets.BASE.items())
    kinds = ", ".join(f"'{k}'" for k in secrets.KINDS)
    endpoint, identifier = (p.replace("'", "''") for p in (secrets.ENDPOINT, secrets.IDENTIFIER))
    near = f"""EXISTS (SELECT 1 FROM p WHERE p.id = w.id AND p.scope = w.scope AND p.k IN ({{}})
      AND (p.e BETWEEN w.s - {secrets.REACH} AND w.s OR p.s BETWEEN w.e AND w.e + {secrets.REACH}))"""
    what, who = near.format("'assign', 'hex', 'credential'"), near.format("'access', 'identifier'")
    both = near.format("'access', 'identifier', 'endpoint'")
    order = f"list_position([{kinds}], k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), base AS (SELECT id, k, e - length(whole) AS s, e FROM ({base}) WHERE length(value) >= CASE k {least} END
), raw AS ({_matches("weak", secrets.WEAK, 0)}
), weak AS (
  SELECT id, e - length(whole) AS s, e, CASE
    WHEN whole LIKE chr(10) || '%' THEN 'border'
    WHEN regexp_matches(whole, '^(?:{endpoint})') THEN 'endpoint'
    WHEN regexp_matches(whole, '^(?:{identifier})') THEN 'identifier'
    WHEN regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[A-Z]') AND regexp_matches(whole, '[a-z]') THEN 'credential' END AS k
  FROM raw
), parts AS (
  SELECT id, k, s, e FROM base UNION ALL
  SELECT id, k, s, e FROM weak w WHERE k <> 'border' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.id = w.id AND b.s < w.e AND b.e > w.s)
), p AS (
  SELECT parts.id, parts.k, parts.s, parts.e, count(b.s) AS scope
  FROM parts LEFT JOIN weak b ON b.id = parts.id AND b.k = 'border' AND b.s <= parts.s GROUP BY ALL
), spans AS (
  SELECT id, k, s, e FROM base UNION ALL
  SELECT id, k, s, e FROM p w WHERE (k = 'identifier' AND {what}) OR (k = 'credential' AND {both})
    OR (k = 'endpoint' AND {who} AND {what})
)
SELECT doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access,
  count(*) FILTER (k = 'hex') AS n_hex,
  sha256(coalesce(string_agg(concat_ws(':', k, s, e), ',' ORDER BY s, {order}) FILTER (k IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(concat_ws(':', k, s, e), ',' ORDER BY s, {order}) FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (id) GROUP BY d.id, doc_id
"""


ORACLES["op11_linked_secrets"] = _secrets_sql()


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY k) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
    WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 6 AS h
  FROM o
), b AS (
  SELECT h.conv_id, list_concat(coalesce(o.turns[1:h], []), h.turns[h + 1:]) AS path
  FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100
), m AS (
  SELECT conv_id, len(path) AS size, d, path[1:d] AS node FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM b)
), n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends
  FROM m GROUP BY node, d
), f AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n c WHERE c.d = n.d + 1 AND c.node[1:n.d] = n.node) AS n_children,
    CASE WHEN n.d > 0 THEN (n.n_convs - 1) * length(n.node[n.d].x) ELSE 0 END AS saved
  FROM n LEFT JOIN n p ON p.d = n.d - 1 AND n.node[1:n.d - 1] = p.node
)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children,
  count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum(c.saved) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM f a JOIN f c ON c.d >= a.d AND c.node[1:a.d] = a.node
GROUP BY a.node, a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ends
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents, by language."""
    return source_divergence(read(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), o AS (SELECT id, lang, source, unnest(t) AS term FROM d
), k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM p JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
