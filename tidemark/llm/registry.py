"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidemark.llm import chat, cover_tree, fim, language_id, minhash, mixing, ogg, periodic_runs, quality, rotated_codes, sentencepiece_codec, url_filter, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_minhash": minhash.op3_minhash,
    "op4_cover_tree": cover_tree.op4_cover_tree,
    "op5_ogg": ogg.op5_ogg,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": language_id.op9_language_id,
    "op10_chat_format": chat.op10_chat_format,
    "op11_rotated_codes": rotated_codes.op11_rotated_codes,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op2_warc": warc.op2_sql(),
    "op3_minhash": minhash.op3_sql(),
    "op4_cover_tree": cover_tree.op4_sql(),
    "op6_url_filter": url_filter.op6_sql(),
    "op10_chat_format": chat.op10_sql(),
    "op11_rotated_codes": rotated_codes.op11_sql(),
    "op12_periodic_runs": periodic_runs.op12_sql(),
    "op13_fill_in_middle": fim.op13_sql(),
}
