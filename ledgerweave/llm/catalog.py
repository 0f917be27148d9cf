"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from . import embeddings, exact_dedup, language, mixing, near_dedup, packing, pieces, private_data, quality, sharding, token_counts, vector_codes, whitening


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_language_id": language.op2_language_id,
        "op3_quality": quality.op3_quality,
        "op4_embedding_near_dedup": embeddings.op4_embedding_near_dedup,
        "op5_extendible_shards": sharding.op5_extendible_shards,
        "op6_private_data": private_data.op6_private_data,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
        "op9_sentence_pieces": pieces.op9_sentence_pieces,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_source_mixing": mixing.op12_source_mixing,
        "op13_vector_codes": vector_codes.op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return exact_dedup.ORACLE | sharding.ORACLE | embeddings.ORACLE | near_dedup.ORACLE | mixing.ORACLE | vector_codes.ORACLE
