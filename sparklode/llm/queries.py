"""Queries ``opN_<name>`` over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm import jaccard, mainhtml, mixing, neighbours, pieces, pii, prefix_trie, quality_model, quality_rules, repeats, secrets, sql_of_new, url_rules, vector_codes
from sparklode.llm.store import table


def op1_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.fitted(docs, table(spark, sf_dir, "labels")))


def op3_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scanned(table(spark, sf_dir, "documents")))


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.searched(table(spark, sf_dir, "embeddings"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocated(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.cleaned(table(spark, sf_dir, "documents")))


def op7_cut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extracted(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.grouped(table(spark, sf_dir, "documents"), n=3, similarity=Fraction(9, 10)).select("doc_id", "n_shingles", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scanned(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judged(pages, url_rules.labelled(pages, table(spark, sf_dir, "labels")))


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shared_prefix_pieces": op1_shared_prefix_pieces,
        "op2_ordinal_quality": op2_ordinal_quality,
        "op3_pii_field": op3_pii_field,
        "op4_adaptive_scan": op4_adaptive_scan,
        "op5_pareto_mix": op5_pareto_mix,
        "op6_merged_transforms": op6_merged_transforms,
        "op7_cut_main_text": op7_cut_main_text,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_quality_rules": op9_quality_rules,
        "op10_secret_scan": op10_secret_scan,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_url_rules": op12_url_rules,
        "op13_annular_codes": op13_annular_codes,
    }


def _words(column: str) -> str:
    return rf"regexp_extract_all(coalesce({column}, ''), '[^\x20\x09-\x0D]+')"


def _mix_sql(documents: str = "documents") -> str:
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"
    return f"""
WITH sized AS (
  SELECT doc_id, source, len({_words("text")})::BIGINT AS size,
         (('0x' || substr(md5('{mixing.SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE AS u
  FROM {documents}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, {weight} AS w, source_size * 2.0::DOUBLE AS cap FROM sources),
line AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS allw,
         coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS capsum, coalesce(sum(w) OVER before, 0.0::DOUBLE) AS wsum
  FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
units AS (SELECT *, (total - capsum) / (allw - wsum) AS unit FROM line),
opened AS (SELECT *, cap > unit * w AS is_open FROM units),
goal AS (
  SELECT source, source_size, CASE WHEN is_open THEN w * (SELECT min_by(unit, cap / w) FROM opened WHERE is_open) ELSE cap END AS target FROM opened),
mass AS (SELECT source, sum(({mixing.SOME} + least(size, {mixing.FULL})) * size)::BIGINT AS m FROM sized GROUP BY source),
due AS (
  SELECT s.doc_id, s.source, s.size, s.u, g.source_size, g.target, mass.m,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole, g.target - whole * g.source_size AS rest
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source JOIN mass ON s.source IS NOT DISTINCT FROM mass.source),
chance AS (SELECT *, CASE WHEN rest > 0 AND size > 0 THEN least(rest * ({mixing.SOME} + least(size, {mixing.FULL})) / m, {mixing.NEAR_ONE!r}::DOUBLE) ELSE 0 END AS p FROM due),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id::VARCHAR, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum
  FROM chance)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN p > 0 AND 2 * cum + size <= 2 * rest THEN size ELSE 0 END)::BIGINT AS taken
FROM ranked"""


def _rules_sql() -> str:
    verdict = " AND ".join(
        f"({r.value}) {op} {bound!r}" for r in (*quality_rules.BASE, *quality_rules.TABLE) for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    ).replace("0D", "0").replace(" / ", "::DOUBLE / ")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, {_words("text")} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM split),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
measures AS (
  SELECT s.doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(list_append(ws, ''), 'string_agg', ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda w: w IN ({stop})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_loud
  FROM split s LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, ({verdict}) AS kept
FROM measures"""


JACCARD_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM split WHERE len(ws) IN (1, 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, c) AS (SELECT doc_id, doc_id FROM split UNION SELECT b, c FROM reach JOIN ends ON a = v)
SELECT s.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM split s LEFT JOIN sizes z USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) r ON r.v = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_pareto_mix": _mix_sql(), "op8_jaccard_join": JACCARD_SQL.strip(), "op9_quality_rules": _rules_sql()} | sql_of_new.SQL
