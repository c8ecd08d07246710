"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from tessera.llm import byte_bpe, collocations, fingerprints, language, mixing, piece_bpe, quality, simhash, suffix_dedup, topk, url_filter, warc, whitening

QUERIES = {
    "op1_url_redirects": url_filter.op1_url_redirects,
    "op2_arc_to_warc": warc.op2_arc_to_warc,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_canonical_digest": fingerprints.op4_canonical_digest,
    "op5_language_hierarchy": language.op5_language_hierarchy,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_quality_ftrl": quality.op7_quality_ftrl,
    "op8_simhash_gray_index": simhash.op8_simhash_gray_index,
    "op9_suffix_lpf": suffix_dedup.op9_suffix_lpf,
    "op10_mix_raked": mixing.op10_mix_raked,
    "op11_piece_rounds": piece_bpe.op11_piece_rounds,
    "op12_whitening_jacobi": whitening.op12_whitening_jacobi,
    "op13_collocation_automata": collocations.op13_collocation_automata,
}

ORACLES = {
    "op1_url_redirects": url_filter.QUERY_SQL,
    "op2_arc_to_warc": warc.ORACLE_SQL,
    "op6_exact_topk": topk.ORACLE_SQL,
    "op10_mix_raked": mixing.ORACLE_SQL,
    "op13_collocation_automata": collocations.ORACLE_SQL,
}
