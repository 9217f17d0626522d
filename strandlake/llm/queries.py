"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, embedding, line_dedup, lm, mixing, negatives, passages, quality, simhash, toxicity, trie, warc

_MODULES = [simhash, line_dedup, chat, passages, decontaminate, lm, warc, quality, embedding, mixing, toxicity, negatives, trie]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in getattr(m, "ORACLE", {}).items()}
