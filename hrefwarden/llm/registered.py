"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from hrefwarden.llm import (
    bpe,
    divergence,
    fingerprints,
    line_dedup,
    minhash,
    mixing,
    pseudo_likelihood,
    quality_rules,
    quality_trees,
    secret_scan,
    spelling,
    suffix_dedup,
    warc,
)

QUERIES = {
    query.__name__: query
    for query in (
        secret_scan.op1_secret_scans,
        pseudo_likelihood.op2_pseudo_likelihood,
        quality_rules.op3_quality_rules,
        fingerprints.op4_fingerprints,
        mixing.op5_mixing,
        bpe.op6_bpe,
        suffix_dedup.op7_suffix_dedup,
        minhash.op8_minhash,
        warc.op9_warc,
        quality_trees.op10_quality_trees,
        divergence.op11_source_divergence,
        spelling.op12_spelling_variants,
        line_dedup.op13_line_dedup,
    )
}

SQL = {
    "op1_secret_scans": secret_scan.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op4_fingerprints": fingerprints.SQL,
    "op9_warc": warc.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
