"""The queries of this folder and their SQL."""

from __future__ import annotations

from quire.llm import bpe, langid, line_dedup, ngram_trie, nn_descent, packing, prefix_trie, quality, sharding, simhash, token_counts, toxicity, va_file

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_kd_sharding": sharding.op6_kd_sharding,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_nn_descent": nn_descent.op8_nn_descent,
    "op9_ngram_trie": ngram_trie.op9_ngram_trie,
    "op10_langid": langid.op10_langid,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_va_file": va_file.op12_va_file,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op7_quality_rules": quality.OP7_SQL,
    "op8_nn_descent": nn_descent.OP8_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_va_file": va_file.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
