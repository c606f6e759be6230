"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .common import documents
from .packing import pack_documents
from . import fingerprints, langid, line_crf, line_dedup, ngram_join, ppm, quality_rules, recompress


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judge(documents(spark, sf_dir), labels)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_held_out(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_matches(documents(spark, sf_dir), min_words=1).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_edit_fingerprints, op3_ppm_score, op4_language_id, op5_line_crf, op6_line_dedup, op7_byte_bpe, op8_ngram_join, op9_packing, op10_repeated_passages)}


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEXT = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"

#: Equal sets of shingles, links by counts of common ones, and all that links reach.
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos, len(x) AS many
  FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS x FROM documents)),
g AS (SELECT doc_id, many, string_agg(word, ' ') {_NEXT.format(4)} AS g, pos, count(*) {_NEXT.format(4)} AS n FROM w),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE n = 5 OR (many < 5 AND pos = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY 1
"""

#: Windows of 20 words by their text; all but the first of each cover words that go.
OP10_SQL = f"""
WITH w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS x FROM documents)),
g AS (SELECT doc_id, pos, string_agg(word, ' ') {_NEXT.format(19)} AS g, count(*) {_NEXT.format(19)} AS n FROM w),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM g WHERE n = 20),
c AS (SELECT w.doc_id, w.pos, word, max(coalesce(k, 1)) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 1 AS gone
  FROM w LEFT JOIN k ON w.doc_id = k.doc_id AND w.pos = k.pos)
SELECT d.doc_id, count(c.word) AS n_words, count(c.word) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY 1
"""

#: Distinct sets of words in order of their first lines, candidates by the prefix filter, common words counted.
OP6_SQL = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM t),
b AS (SELECT *, list_sort(list_distinct(regexp_extract_all({_LOWER.format("line")}, '{_WORD}'))) AS b FROM l),
f AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS i, CASE WHEN len(b) > 0 THEN min(doc_id * 1000000 + pos) OVER (PARTITION BY b) END AS one FROM b),
e AS (SELECT one, unnest(b) AS word, len(b) AS n FROM f WHERE doc_id * 1000000 + pos = one),
o AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY df, word) AS k FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df FROM e)),
q AS (SELECT * FROM o WHERE k <= n - CAST(ceil(n * 80 / 100.0) AS BIGINT) + 1 AND df > 1),
p AS (SELECT DISTINCT x.one AS x, y.one AS y, x.n AS nx, y.n AS ny FROM q x JOIN q y ON x.word = y.word AND y.one < x.one AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
  WHERE 180 * (1 + least(x.n - x.k, y.n - y.k)) >= 80 * (x.n + y.n)),
m AS (SELECT x FROM p JOIN e a ON a.one = x JOIN e c ON c.one = y AND c.word = a.word GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
v AS (SELECT f.*, one IS NOT NULL AND (doc_id * 1000000 + pos <> one OR one IN (SELECT x FROM m)) AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM v GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op8_ngram_join": OP8_SQL, "op10_repeated_passages": OP10_SQL}
