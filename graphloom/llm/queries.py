"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from graphloom.llm import decontaminate, hard_negatives, jaccard_join, nearest, oracles, packing, page_text, personal_data, pipeline, quality, secrets, substring_dedup, token_counts, toxicity, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_personal_data": personal_data.op3,
    "op4_nearest": nearest.op4,
    "op5_toxicity": toxicity.op5,
    "op6_packing": packing.op6,
    "op7_substring_dedup": substring_dedup.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_page_text": page_text.op9,
    "op10_secrets": secrets.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_whitening": whitening.op12,
    "op13_quality_rules": quality.op13,
    "pipeline": pipeline.run,
}

#: The rest is tested against brute force in tests/llm.
SQL = oracles.SQL
