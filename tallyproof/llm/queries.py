"""The queries of this folder's operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm import ann, audio, html_template, mixing, near_dup, packing, pii, prefix_trie, quality, token_counts, token_output, warc, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op2_quality_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op5_linear_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(_documents(spark, sf_dir))


def op6_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_seekable_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(_documents(spark, sf_dir))


def op9_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii_weak_supervision, op2_quality_weak_labels, op3_warc_segments, op4_pattern_packing, op5_linear_word_pieces, op6_weighted_mixing, op7_permutation_index, op8_seekable_token_frames, op9_multi_index_hamming, op10_audio_features, op11_prefix_trie, op12_template_text, op13_jacobi_whitening)
    return {f.__name__: f for f in own}


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.x, p.y FROM p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * p.c >= 75 * (nx.n + ny.n - p.c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_segments": warc.WARC_SQL, "op6_weighted_mixing": mixing.MIX_SQL, "op9_multi_index_hamming": NEAR_SQL, "op11_prefix_trie": prefix_trie.TRIE_SQL}
