"""One query for each operator: the operator over its whole tables, brought
into the columns that the query's contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, htmltext, licenses, packing, pitman_yor, repeats, secrets, simhash, topk, toxicity, trie, warc
from .common import table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.digest(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return packing.pack(docs, tokenizer_path())


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents")).drop("places")


QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_simhash_components": op2_simhash_components,
    "op3_decontamination": op3_decontamination,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_toxicity": op5_toxicity,
    "op6_main_text": op6_main_text,
    "op7_mixture_packing": op7_mixture_packing,
    "op8_repeated_bytes": op8_repeated_bytes,
    "op9_exact_topk": op9_exact_topk,
    "op10_secret_linking": op10_secret_linking,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op4_warc_round_trip": warc.ORACLE,
    "op9_exact_topk": topk.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
    "op12_vector_codes": codes.ORACLE,
}
