"""The llm queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import covertree, huffman, packing, pseudolikelihood, quality_rules, sentencepieces, simhash, suffixdedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_pseudo_likelihood": pseudolikelihood.op1,
        "op2_suffix_dedup": suffixdedup.op2,
        "op3_sentencepiece": sentencepieces.op3,
        "op4_huffman": huffman.op4,
        "op5_warc": warc.op5,
        "op6_toxicity": toxicity.op6,
        "op7_cover_tree": covertree.op7,
        "op8_quality_rules": quality_rules.op8,
        "op9_packing": packing.op9,
        "op10_simhash": simhash.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.OP5_SQL, "op7_cover_tree": covertree.OP7_SQL}
