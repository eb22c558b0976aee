"""Registered queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.core import let
from refloom.llm import (
    bpe_count,
    cotraining,
    embeddings,
    html_mincut,
    line_dedup,
    merkle,
    mixing,
    periodic,
    piece_codec,
    pii,
    quality_rules,
    simhash,
    toxicity,
)
from refloom.llm.common import WORD_CLASS, table, text_of, words_of
from refloom.plans.registry import query


@query(name="op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

QUALITY_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: rtrim(lower(x), '.,;:') IN ({_STOPS})))::BIGINT AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09]*(?:[-*•‣◦]|[0-9]+[.)])\\x20')))::BIGINT AS n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipses
  FROM base LEFT JOIN covered c USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 100000
  AND word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 12.0
  AND n_symbols / greatest(word_chars, 1) <= 0.05
  AND n_stop_words / greatest(n_words, 1) >= 0.06
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5
  AND n_bullets / greatest(n_lines, 1) <= 0.9
  AND n_ellipses / greatest(n_lines, 1) <= 0.3 AS kept
FROM j"""


@query(QUALITY_SQL, name="op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(name="op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(name="op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_codec.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(name="op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.n_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans")
    )


@query(name="op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(name="op10_embedding_dedup")
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(name="op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(name="op1_html_mincut")
def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extracted(table(spark, sf_dir, "pages"))


@query(name="op6_quality_cotraining")
def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
    lambda acc, b: list_reduce([xor(acc, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


def _leaf_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


_UP = "list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], '')))"

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
    {_leaf_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("doc_id", "source", "lang", "(n_chars + 1)", "text")} END AS tampered
  FROM documents),
nodes(tree, level, l) AS (
  SELECT tree, 0, list(leaf ORDER BY doc_id NULLS FIRST, leaf) FROM leaves GROUP BY tree
  UNION ALL SELECT tree, level + 1, {_UP} FROM nodes WHERE len(l) > 1),
subroots AS (SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE len(l) = 1),
top(level, l) AS (
  SELECT 0, list(subroot ORDER BY tree) FROM subroots
  UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(l) > 1),
flat AS (SELECT tree, level, unnest(l) AS node, generate_subscripts(l, 1) - 1 AS i FROM nodes WHERE len(l) > 1),
top_flat AS (SELECT level, unnest(l) AS node, generate_subscripts(l, 1) - 1 AS i FROM top WHERE len(l) > 1),
placed AS (
  SELECT *, row_number() OVER (ORDER BY tree) AS r,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS at
  FROM leaves),
steps AS (
  SELECT p.r, x.level, CASE WHEN (p.at >> x.level) & 1 = 1 THEN 'L' ELSE 'R' END AS side, n.node
  FROM placed p JOIN nodes x ON x.tree = p.tree AND len(x.l) > 1
  LEFT JOIN flat n ON n.tree = p.tree AND n.level = x.level AND n.i = xor(p.at >> x.level, 1)
  UNION ALL
  SELECT p.r, 1000 + x.level, CASE WHEN (s.pos >> x.level) & 1 = 1 THEN 'L' ELSE 'R' END, n.node
  FROM placed p JOIN subroots s USING (tree) JOIN top x ON len(x.l) > 1
  LEFT JOIN top_flat n ON n.level = x.level AND n.i = xor(s.pos >> x.level, 1)),
proofs AS (
  SELECT r, list(side || coalesce(node, '') ORDER BY level) AS path, string_agg(coalesce(node, ''), '' ORDER BY level) AS proof
  FROM steps GROUP BY r),
folded AS (
  SELECT p.*, s.subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    list_reduce([coalesce(tampered, leaf)] || coalesce(q.path, []),
      lambda a, b: sha256(CASE WHEN b[1] = 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
  FROM placed p JOIN subroots s USING (tree) LEFT JOIN proofs q USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


@query(MERKLE_SQL, name="op11_merkle_manifest")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = F.when(touched, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), claimed={"n_chars": more})
    folded = rows.withColumn("folded_root", merkle.fold(F.col("claimed_leaf"), F.col("path")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_hash(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text; for a tenth of the documents its words from some place on are replaced by repeats of the first few of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    touched = F.coalesce(h % 10 == 0, F.lit(False)) & text.rlike(WORD_CLASS)
    return F.when(touched, let(words_of(text), planted)).otherwise(text)


@query(name="op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", _with_planted_runs(F.col("doc_id"), text_of("text")).alias("text"))
    rows = periodic.find_runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
WITH base AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM base),
keyed AS (
  SELECT *, translate(trim(line, {_BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
judged AS (
  SELECT x.*, h.k IS NOT NULL AND h.holder IS DISTINCT FROM x.doc_id AS gone FROM keyed x LEFT JOIN held h ON h.k = x.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id"""


@query(LINES_SQL, name="op13_line_dedup")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(name="pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
