"""The queries of this package: name -> callable, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from corefkit.llm import (bpe, divergence, exact_dedup, line_dedup, mixing, periodic_runs, quality_fm, scaled_sketch, simhash,
                          substring_dedup, token_counts, toxicity, url_filter)

QUERIES = {
    "op1_quality_fm": quality_fm.query,
    "op2_scaled_sketch": scaled_sketch.query,
    "op3_sainte_lague": mixing.query,
    "op4_byte_bpe": bpe.query,
    "op5_url_cascade": url_filter.query,
    "op6_line_dedup": line_dedup.query,
    "op7_simhash": simhash.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_token_counts": token_counts.query,
    "op12_divergence_audit": divergence.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLES = {
    "op6_line_dedup": line_dedup.ORACLE,
    "op3_sainte_lague": mixing.ORACLE,
    "op5_url_cascade": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_divergence_audit": divergence.ORACLE,
}
