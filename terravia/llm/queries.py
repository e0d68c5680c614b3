"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontamination, jaccard, media, quality, sharding, substrings, toxicity, warc

QUERIES = {
    "op1_quality_classifier": quality.op1,
    "op2_substring_dedup": substrings.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_media_columns": media.op4,
    "op5_decontamination": decontamination.op5,
    "op6_toxicity": toxicity.op6,
    "op7_chat_formatting": chat.op7,
    "op8_warc": warc.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_sharding": sharding.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontamination.sql(),
    "op7_chat_formatting": chat.SQL,
    "op8_warc": warc.SQL,
    "op9_jaccard_join": jaccard.sql(3, 90),
    "op10_sharding": sharding.sql(),
}
