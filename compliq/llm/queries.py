"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from compliq.llm import decontaminate, exact_dedup, mixing, quality, repeats, sharding, simhash, token_count, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": repeats.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_sharding": sharding.op6_sharding,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_counts": token_count.op10_token_counts,
}
ORACLE_SQL = {k: v for m in (decontaminate, exact_dedup, mixing, quality, repeats, sharding, simhash, token_count, toxicity, url_filter) for k, v in m.SQL.items()}
