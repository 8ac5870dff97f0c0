"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from vitrine.llm import ann, bpe, chat, codes, decontaminate, mixing, periodic, quality, simhash, substring_dedup, suffix_dedup, toxicity, warc

MODULES = (simhash, substring_dedup, toxicity, ann, chat, quality, bpe, suffix_dedup, mixing, warc, periodic, decontaminate, codes)


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= m.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= m.ORACLE_SQL
    return found
