"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.attribution import count_section_tokens
from cohortloom.llm.chat import format_conversations, read_back
from cohortloom.llm.context_tree import score_documents
from cohortloom.llm.decontamination import find_leaks
from cohortloom.llm.epsilon_grid import link_vectors
from cohortloom.llm.fill_in_middle import digest_documents, transform_pieces
from cohortloom.llm.minhash import near_duplicates
from cohortloom.llm.oracles import ORACLES
from cohortloom.llm.packing import pack_documents
from cohortloom.llm.pair_alignment import align_documents
from cohortloom.llm.pair_alignment import score_documents as score_alignment
from cohortloom.llm.pii import find_personal_data
from cohortloom.llm.quality import grade_documents
from cohortloom.llm.sentence_pieces import encode_documents
from cohortloom.llm.toxicity import score_toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver did, if they have that path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its site, the language its path."""
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def epsilon_grid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted windows, with one conversation of control strings added."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(text).alias("text"))
    return read_back(format_conversations(turns.unionByName(added))).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")


def semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def inverted_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(
        table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return score_alignment(aligned).drop("groups")


def secondary_sort_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(transform_pieces(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_token_counts": token_counts,
    "op3_hierarchical_quality": hierarchical_quality,
    "op4_nonnegative_pu_toxicity": nonnegative_pu_toxicity,
    "op5_minmax_near_dedup": minmax_near_dedup,
    "op6_budgeted_chat_windows": budgeted_chat_windows,
    "op7_epsilon_grid_links": epsilon_grid_links,
    "op8_context_tree_scores": context_tree_scores,
    "op9_semi_markov_pii": semi_markov_pii,
    "op10_simhash_decontamination": simhash_decontamination,
    "op11_distinct_chunk_pieces": distinct_chunk_pieces,
    "op12_inverted_pair_alignment": inverted_pair_alignment,
    "op13_secondary_sort_fill_in_middle": secondary_sort_fill_in_middle,
}
