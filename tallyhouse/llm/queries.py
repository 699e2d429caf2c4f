"""Registered queries of the text operators and, where SQL can express them, the same result in SQL."""

from __future__ import annotations

import corpus_pipeline
from tallyhouse.llm import (
    bpe, decontaminate, exact_dedup, lang_id, licences, line_dedup, ngram_join, pii, prefix_trie, repeats, token_counts,
    vector_codes, warc,
)

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_dedup": repeats.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_language_id": lang_id.op4_language_id,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_pii": pii.op8_pii,
    "op9_licences": licences.op9_licences,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_warc": warc.op13_warc,
}

SQL = {
    "op3_token_counts": token_counts.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
