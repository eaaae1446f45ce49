"""The operators' queries on the driver's tables, and SQL for those that SQL can express.

Only these thin queries know table names; a table's path is always read by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import chat, language_id, license_scan, media, mixing, packing, quality_model, quality_rules, shared, simhash, warc

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where this box keeps the tokenizer; a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarised(license_scan.scan(_table(spark, sf_dir, "documents")))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predicted(docs.select("doc_id", "text"), language_id.fit(docs), ["doc_id"])
    return found.select("doc_id", (shared.crc_of() % 5 == 0).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality_model.scored(docs.select("doc_id", "text"), quality_model.fit(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", (shared.crc_of() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op10_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read_archives(warc.write_archives(pages), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_gif_media, op4_entropy_mixing, op5_language_id, op6_simhash,
        op7_chat_snapshots, op8_quality_classifier, op9_quality_rules, op10_zstd_warc)
}


def _license_sql() -> str:
    """Votes as a join with the indexed words, those within the tolerance counted, key phrases looked for near their places."""
    templates = license_scan.TEMPLATES
    index = license_scan.index_of(templates)
    need = license_scan.needed(templates, index)
    size = Counter(a.template for a in index)
    anchors = ", ".join(f"({a.template}, {a.number}, {a.at}, '{a.word}')" for a in index)
    facts = (", ".join(f"({n}, {need[n]}, {t.tolerance}, {size[n]}, '{t.label}', {str(t.base).lower()}, {t.specific!r})" for n, t in enumerate(
        templates)))
    keys = ", ".join(f"({n}, {at}, {k}, ' {p} ')" for n, t in enumerate(templates) for at, k, p in t.keys)
    return f"""
WITH anchors(t, a, place, word) AS (VALUES {anchors}),
facts(t, need, tolerance, indexed, label, base, specific) AS (VALUES {facts}),
keys(t, place, n, phrase) AS (VALUES {keys}),
words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM documents
), hits AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM words
), votes AS (
  SELECT DISTINCT h.r, a.t, a.a, h.i - a.place AS d FROM hits h JOIN anchors a USING (word)
), agreed AS (
  SELECT v.r, v.t, v.d, count(DISTINCT x.a) AS n
  FROM (SELECT DISTINCT r, t, d FROM votes) v JOIN facts f USING (t) JOIN votes x ON x.r = v.r AND x.t = v.t AND x.d BETWEEN v.d AND v.d + f.tolerance
  GROUP BY v.r, v.t, v.d, f.need HAVING count(DISTINCT x.a) >= f.need
), looked AS (
  SELECT g.r, g.t, g.d, g.n, contains(' ' || array_to_string(w.w[greatest(0, g.d + k.place - f.tolerance) + 1:greatest(0, g.d + k.place + k.n + f.tolerance)], ' ') || ' ', k.phrase) AS holds
  FROM agreed g JOIN facts f USING (t) JOIN keys k USING (t) JOIN words w ON w.r = g.r
), found AS (
  SELECT l.r, l.d, f.label, f.base, l.n / f.indexed * f.specific AS score
  FROM (SELECT r, t, d, n FROM looked GROUP BY r, t, d, n HAVING bool_and(holds)) l JOIN facts f USING (t)
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, count(*) FILTER (f.base) AS n_base,
  CAST(min(f.d) FILTER (f.base) AS BIGINT) AS first_word, CAST(max(f.d) FILTER (f.base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
  CAST(coalesce(max(f.score), 0) AS DOUBLE) AS score
FROM words w LEFT JOIN found f ON f.r = w.r
GROUP BY w.r, w.doc_id, w.w"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op7_chat_snapshots": """
WITH turns AS (
  SELECT conv_id, turn, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), placed AS (
  SELECT conv_id, rendered, row_number() OVER w AS place, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), logged AS (
  SELECT conv_id, count(*) AS n, string_agg(rendered, '' ORDER BY place) AS whole FROM placed GROUP BY conv_id
), distinct_logged AS (
  SELECT min(conv_id) AS conv_id, n, whole, count(*) AS copies FROM logged GROUP BY n, whole
)
SELECT a.conv_id, CAST(p.place AS BIGINT) AS place, CAST(a.n AS BIGINT) AS n_turns, CAST(a.copies AS BIGINT) AS n_copies, CAST(p.start AS BIGINT) AS start, p.rendered
FROM distinct_logged a JOIN placed p ON p.conv_id = a.conv_id
WHERE NOT EXISTS (SELECT 1 FROM distinct_logged b WHERE b.n > a.n AND starts_with(b.whole, a.whole))""",
}
