"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, hmm, language, line_dedup, merkle, mixture, pieces, quality, simhash, warc

QUERIES = {
    "op1_merkle": merkle.op1_merkle,
    "op2_mixture": mixture.op2_mixture,
    "op3_chat": chat.op3_chat,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_line_spread": line_dedup.op6_line_spread,
    "op7_line_frequency": quality.op7_line_frequency,
    "op8_merge_dropout": pieces.op8_merge_dropout,
    "op9_bigru": language.op9_bigru,
    "op10_hmm": hmm.op10_hmm,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_chat": chat.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_line_spread": line_dedup.OP6_SQL,
    "op7_line_frequency": quality.OP7_SQL,
}
