"""The registered queries of this subpackage: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bitslice, bpe, convtrie, lattice, licenses, lines, merkle, packing, pii, piececount, quality, simhash, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and accepted spans of personal data in every document."""
    return pii.detect(_table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector."""
    return bitslice.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and those that go as copies or near copies of others."""
    return lines.document_classes(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and prediction of every document."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"), RULES)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link count and component of every vector, within equal labels."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, children, leaves and savings of every node of the conversations' prefix trie."""
    return convtrie.trie(_table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return piececount.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its check of every document."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP9_SQL = """
WITH rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fitting AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE n = 1
"""

def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ASCII text."""
    step = "xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(r, b), range(8)), lambda d, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda r, b: {byte}), 4294967295)"


OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
  SELECT v.c, 0 AS part, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
  UNION ALL SELECT v.c, 1, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, count(*) OVER (PARTITION BY c) AS size,
         sha256(length(role) || ':' || role || text) AS digest FROM rebuilt
), prefixes AS (
  SELECT c, depth, size, text, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM numbered
), members AS (
  SELECT c, depth, size, text, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), 'root') AS parent FROM prefixes
  UNION ALL SELECT v.c, 0, coalesce(n.size, 0), '', 'root', NULL FROM convs v LEFT JOIN (SELECT DISTINCT c, size FROM numbered) n ON n.c = v.c
), nodes AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * min(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM members GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT m.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM nodes u JOIN members m ON m.c = u.conv_id AND m.depth <= u.depth LEFT JOIN children k ON k.node = u.node GROUP BY m.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""


def _merkle_sql(levels: int = 8) -> str:
    """Two trees of up to 8^levels leaves, one level at a time; a single node goes up as it is."""

    def tree(name: str, key: str) -> str:
        out = []
        for i in range(levels):
            out.append(f"""{name}s{i} AS (
  SELECT {key}, pos, h, n, pos // 8 AS run, CASE WHEN n = 1 THEN '' ELSE string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS l,
         CASE WHEN n = 1 THEN '' ELSE string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS r
  FROM {name}{i} WINDOW w AS (PARTITION BY {key}, pos // 8 ORDER BY pos)
), {name}{i + 1} AS (
  SELECT {key}, run AS pos, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (max(n) + 7) // 8 AS n FROM {name}s{i} GROUP BY {key}, run
)""")
        return ", ".join(out)

    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def folded(name: str, start: str) -> str:
        for i in range(levels):
            start = f"(CASE WHEN {name}n{i} = 1 THEN {start} ELSE sha256(coalesce({name}l{i}, '') || {start} || coalesce({name}r{i}, '')) END)"
        return start

    up = ", ".join(f"{t}{i}.l AS {t}l{i}, {t}{i}.r AS {t}r{i}, {t}{i}.n AS {t}n{i}" for t in ("a", "b") for i in range(levels))
    proof = " || ".join(f"coalesce({t}l{i}, '') || coalesce({t}r{i}, '')" for t in ("a", "b") for i in range(levels))
    joins = "".join(f" JOIN treea_s{i} a{i} ON a{i}.g = d.g AND a{i}.pos = d.pos // {8**i}" for i in range(levels))
    joins += "".join(f" JOIN treeb_s{i} b{i} ON b{i}.pos = s.pos // {8**i}" for i in range(levels))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS other FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), treea_0 AS (SELECT g, pos, leaf AS h, n FROM placed), {tree("treea_", "g")}, subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM treea_{levels}
), treeb_0 AS (SELECT 0 AS g, pos, subroot AS h, n FROM subroots), {tree("treeb_", "g")}, up AS (
  SELECT d.doc_id, d.leaf, d.other, s.subroot, t.h AS root, {up}
  FROM placed d JOIN subroots s ON s.g = d.g{joins} CROSS JOIN treeb_{levels} t
), judged AS (
  SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {folded("a", "other")} AS half, * EXCLUDE (doc_id, leaf, subroot, root) FROM up
), done AS (SELECT doc_id, leaf, subroot, root, proof_sha256, {folded("b", "half")} AS folded_root FROM judged)
SELECT *, folded_root = root AS verified FROM done
"""
    return text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3_SQL, "op9_url_filters": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op13_merkle_manifest": _merkle_sql()}
