"""Thin queries over the operators: each reads its whole table and returns the columns of its contract."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import bpe, fingerprint, hard_negatives, html_extract, langid, license_scan, line_dedup, merkle, ngram_join, packing, quality, sharding, suffix_dedup
from cataloom.sources.shared import shared_dir
from cataloom.sources.tables import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again."""
    import public_tokenizers

    ranks = bpe.load(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    decode, shown = bpe.Decoder(ranks), [b"%d" % i for i in range(len(ranks.tokens))]

    def digests(ids: pa.ListArray) -> list[pa.Array]:
        flat, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()
        own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        told = [hashlib.sha256(b",".join(map(shown.__getitem__, x.tolist()))).hexdigest() for x in own]
        return [
            pa.array(np.diff(bounds), pa.int64()), pa.array(told, pa.string()),
            pa.array([hashlib.sha256(decode(x)).hexdigest() for x in own], pa.string())
        ]

    return bpe.mapped(
        table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests,
        "n_tokens long, ids_sha256 string, decoded_sha256 string", keep=("doc_id",)
    )


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat, exactly or nearly, an earlier one."""
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards, near equal in bytes; the map is stored as its first version."""
    out = sharding.sharded(table(spark, sf_dir, "documents"), shards=40, map_path=f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "v_slot", "map_version"
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 5-word shingles, Jaccard similarity of 0.75 or more."""
    return ngram_join.classes(
        table(spark, sf_dir, "documents"), words=5, percent=75
    ).select("doc_id", "n_shingles", "component_id", "set_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with cutoffs certified on the labels."""
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rejected_by", ",").alias("rejected_by")
    )


def op6_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_column_wise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeated 100-byte strings from all documents."""
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates found in every document."""
    return license_scan.scanned(table(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; a seventh of the documents is folded with a wrong n_chars."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=(chosen, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}))


def op13_pq_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, where a seventh of the vectors have a wrong label."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", wrong), anchors="vec_id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fuzzy_line_dedup": op2_fuzzy_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_rules": op5_quality_rules,
    "op6_order_min_hash": op6_order_min_hash,
    "op7_tag_path_text": op7_tag_path_text,
    "op8_column_wise_suffix_dedup": op8_column_wise_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_license_templates": op11_license_templates,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pq_hard_negatives": op13_pq_hard_negatives,
}

#: Checksums of short strings, bit by bit; and trees of runs of two, level by level, with the siblings on the way up.
_MERKLE = """WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents),
crc AS (SELECT doc_id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c: list_reduce(list_concat([xor(h, c)], [CAST(i AS BIGINT) FOR i IN range(8)]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inner_
  FROM d),
enc AS (SELECT doc_id, lang, n_chars, coalesce(strlen(k)||':'||k, '-')||coalesce(strlen(source)||':'||source, '-')||coalesce(strlen(lang)||':'||lang, '-') AS a,
  coalesce(strlen(text)||':'||text, '-') AS z FROM d),
leaf AS (SELECT doc_id, lang, sha256(a||coalesce(length(CAST(n_chars AS VARCHAR))||':'||n_chars, '-')||z) AS leaf,
  sha256(a||coalesce(length(CAST(n_chars + 1 AS VARCHAR))||':'||(n_chars + 1), '-')||z) AS other,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM enc),
lv AS (SELECT lang, CAST(0 AS BIGINT) AS level, i, n, leaf AS h FROM leaf UNION ALL
  SELECT lang, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY lang, level, i // 2),
sub AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
top AS (SELECT CAST(0 AS BIGINT) AS level, i, n, subroot AS h FROM sub UNION ALL
  SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2),
steps AS (SELECT doc_id, t.level, (l.i >> t.level) % 2 AS is_right, s.h FROM leaf l JOIN lv t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1
  AND t.i = l.i >> t.level LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.i = xor(t.i, 1)
  UNION ALL SELECT l.doc_id, b.height + t.level, (b.i >> t.level) % 2, s.h FROM leaf l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang
  JOIN top t ON t.n > 1 AND t.i = b.i >> t.level LEFT JOIN top s ON s.level = t.level AND s.i = xor(t.i, 1)),
fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS level, CASE WHEN xor(inner_, 4294967295) % 7 = 0 THEN other ELSE leaf END AS h FROM leaf JOIN crc USING (doc_id)
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(CASE WHEN is_right = 1 THEN coalesce(s.h, '')||f.h ELSE f.h||coalesce(s.h, '') END)
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level)
SELECT l.doc_id, leaf, subroot, r.h AS root, sha256(coalesce(p.told, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified FROM leaf l
  JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang JOIN top r ON r.n = 1 JOIN (SELECT doc_id, arg_max(h, level) AS h FROM fold GROUP BY 1) f USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(h, '' ORDER BY level) AS told FROM steps GROUP BY 1) p USING (doc_id)"""

_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b
  ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id
  ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": _MERKLE, "op13_pq_hard_negatives": _NEGATIVES}
