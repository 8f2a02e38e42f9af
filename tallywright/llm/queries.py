"""The operators' registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallywright.llm import chat, exact_dedup, language_id, line_crf, mixing, pieces, prefix_trie, repair, sentence_spans, simhash, token_coder, warc, weak_labels

QUERIES = {
    "op1_line_crf": line_crf.op1_line_crf,
    "op2_simhash": simhash.op2_simhash,
    "op10_language_id": language_id.op10_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_files": token_coder.op4_token_files,
    "op5_weak_labels": weak_labels.op5_weak_labels,
    "op9_sentence_spans": sentence_spans.op9_sentence_spans,
    "op6_pieces": pieces.op6_pieces,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_mixing": mixing.op8_mixing,
    "op11_warc": warc.op11_warc,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_repair": repair.op13_repair,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
