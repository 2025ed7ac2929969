"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_codec, decontam, html_text, merkle, ngram_join, secrets, substring_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_toxicity": toxicity.query,
    "op3_document_fingerprints": merkle.query,
    "op4_token_files": token_files.query,
    "op5_decontaminate": decontam.query,
    "op6_secret_scans": secrets.query,
    "op7_bpe_codec": bpe_codec.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_html_extraction": html_text.query,
    "op10_token_counts": token_counts.query,
}
SQL: dict[str, str] = {"op6_secret_scans": secrets.SQL}
