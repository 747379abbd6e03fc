"""The contract queries op1 … op13 and the corpus pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, split_remainder


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_lm import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"), split_remainder(10) == 0)


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(read_table(spark, sf_dir, "documents"))


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(read_table(spark, sf_dir, "documents"))


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie_bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import ENCODE_BYTES
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), batch_bytes=ENCODE_BYTES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"))


def op8_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_dedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def _classified(spark: SparkSession, sf_dir: str, module) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = split_remainder(3) == 1
    model = module.fit(docs.where(~held_out), read_table(spark, sf_dir, "labels"))
    scored = module.score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return _classified(spark, sf_dir, toxicity)


def op9_latent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return _classified(spark, sf_dir, quality)


def op11_heap_merge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import rank_documents

    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import link_documents

    return link_documents(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lattice_lm, op2_nnpu_toxicity, op3_trie_bpe, op4_hyperminhash, op5_token_records,
        op6_best_fit_packing, op7_token_counts, op8_pivot_dedup, op9_latent_votes, op10_chunk_recipes,
        op11_heap_merge_search, op12_prefix_table_pieces, op13_token_links, pipeline,
    )
}
