"""The registered queries of this package and their oracle SQL, where SQL can express them."""

from __future__ import annotations

from keydrift.llm import (
    classifier,
    decontamination,
    html_text,
    manifest,
    mixing,
    ngram_join,
    pii,
    quality,
    secrets,
    sharding,
    token_counts,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_reshard": sharding.query,
    "op2_decontaminate": decontamination.query,
    "op3_mix_sources": mixing.query,
    "op4_classify_quality": classifier.query,
    "op5_extract_html": html_text.query,
    "op6_scan_secrets": secrets.query,
    "op7_count_tokens": token_counts.query,
    "op8_quality_rules": quality.query,
    "op9_ngram_join": ngram_join.query,
    "op10_find_pii": pii.query,
    "op11_filter_urls": url_filter.query,
    "op12_whiten_embeddings": whitening.query,
    "op13_merkle_manifest": manifest.query,
}

ORACLE = {
    "op2_decontaminate": decontamination.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_ngram_join": ngram_join.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
