"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from lakehook.llm import (
    alignment,
    bpe,
    decontamination,
    exact_dedup,
    html_extract,
    jaccard_join,
    license_scan,
    near_vectors,
    packing,
    prefix_trie,
    quality,
    url_filter,
    warc_audit,
)

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_near_vectors": near_vectors.op5_near_vectors,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_warc_audit": warc_audit.op8_warc_audit,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_alignment": alignment.op13_alignment,
}

# SQL cannot express 1, 3, 4, 6, 7, 9 and 13: tests hold them against the tokenizers
# library, brute force or planted cases.
ORACLES = {
    "op2_license_scan": license_scan.ORACLE,
    "op8_warc_audit": warc_audit.ORACLE,
    "op5_near_vectors": near_vectors.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
}
