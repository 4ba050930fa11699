"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import ball_kmeans, exact_dedup, fingerprints, language_id, lm_score, mixing, ngram_join, phrases, pieces, quality, suffix_dedup, toxicity, warc


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_lm_score": lm_score.op2_lm_score,
        "op3_quality": quality.op3_quality,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_language_id": language_id.op6_language_id,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_phrases": phrases.op11_phrases,
        "op12_warc": warc.op12_warc,
        "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op10_ngram_join": ngram_join.ORACLE_SQL,
        "op11_phrases": phrases.ORACLE_SQL,
        "op12_warc": warc.ORACLE_SQL,
        "op13_ball_kmeans": ball_kmeans.ORACLE_SQL,
    }
