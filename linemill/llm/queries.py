"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from linemill.llm import bpe, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, quality, token_counts, toxicity, url_filter


def op4(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join.ngram_components(docs, k=4, percent=85)


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_toxicity": toxicity.op2,
        "op3_url_filters": url_filter.op3,
        "op4_ngram_jaccard_join": op4,
        "op5_document_fingerprints": fingerprints.op5,
        "op6_mixing_sources": mixing.op6,
        "op7_quality_classifier": quality.op7,
        "op8_token_counts": token_counts.op8,
        "op9_bpe": bpe.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": url_filter.OP3_SQL, "op8_token_counts": token_counts.OP8_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
