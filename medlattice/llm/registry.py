"""The corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from . import benchmarks, jaccard, language, lines, manifest, nearest, packing, pieces, ranking, secrets, tokens, toxicity, urls

QUERIES = {
    "op1_token_files": tokens.op1_token_files,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_url_filters": urls.op3_url_filters,
    "op4_language_id": language.op4_language_id,
    "op5_nearest": nearest.op5_nearest,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_decontamination": benchmarks.op8_decontamination,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_packing": packing.op12_packing,
    "op13_ranked_search": ranking.op13_ranked_search,
}

#: Queries that SQL can express. The others are tested against brute force, exact round trips or held-out labels (tests/llm).
SQL = {"op3_url_filters": urls.OP3_SQL, "op5_nearest": nearest.OP5_SQL, "op11_merkle_manifest": manifest.OP11_SQL, "op13_ranked_search": ranking.OP13_SQL}
