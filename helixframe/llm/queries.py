"""One query for each operator, over whole tables, as the contracts state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives, html_text, langid, line_dedup, minhash_dedup, mixing, oracles, packing, piece_codec, quality, tiff, token_alignment, token_counts, vector_search
from helixframe.llm.common import crc_of_id, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_of_id() % 3 != 1)
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k_of_every(table(spark, sf_dir, "embeddings"), every=50, k=5)


def tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_texts(table(spark, sf_dir, "documents"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def mine_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", changed), F.col("vec_id") % 100 == 0)


def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_language_id": language_id,
    "op2_minhash_near_dedup": near_dedup,
    "op3_best_fit_packing": pack,
    "op4_quality_classifier": quality_scores,
    "op5_html_extraction": html_main_text,
    "op6_token_counts": count_tokens,
    "op7_exact_top_k": exact_top_k,
    "op8_tiff_media": tiff_media,
    "op9_source_mixing": mix_sources,
    "op10_line_dedup": dedup_lines,
    "op11_piece_codec": piece_encoding,
    "op12_hard_negatives": mine_negatives,
    "op13_token_alignment": align_tokens,
}

ORACLES = {
    "op2_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op7_exact_top_k": oracles.TOP_K,
    "op9_source_mixing": oracles.MIXING,
    "op12_hard_negatives": oracles.NEGATIVES,
}
