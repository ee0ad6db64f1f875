"""The operators' named queries and their SQL twins."""

from __future__ import annotations

from eccentra.llm import op1_decontamination, op2_bottom_k, op3_quality, op4_url_reputation, op5_token_counts, op6_packing, op7_near_dedup, op8_pseudo_likelihood, op9_suffix_dedup, op10_warc, op11_collocations, op12_line_runs, op13_centroids

QUERIES = {
    "op1_spaced_seeds": op1_decontamination.query,
    "op2_bottom_k": op2_bottom_k.query,
    "op3_neighbour_votes": op3_quality.query,
    "op4_url_reputation": op4_url_reputation.query,
    "op5_token_counts": op5_token_counts.query,
    "op6_best_two_fit": op6_packing.query,
    "op7_chosen_path": op7_near_dedup.query,
    "op8_pseudo_likelihood": op8_pseudo_likelihood.query,
    "op9_suffix_blocks": op9_suffix_dedup.query,
    "op10_warc_zstd": op10_warc.query,
    "op11_stream_collocations": op11_collocations.query,
    "op12_line_runs": op12_line_runs.query,
    "op13_rotated_centroids": op13_centroids.query,
}
ORACLES = {"op4_url_reputation": op4_url_reputation.ORACLE, "op7_chosen_path": op7_near_dedup.ORACLE, "op10_warc_zstd": op10_warc.ORACLE,
           "op11_stream_collocations": op11_collocations.ORACLE, "op12_line_runs": op12_line_runs.ORACLE, "op13_rotated_centroids": op13_centroids.ORACLE}
