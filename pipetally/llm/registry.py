"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pipetally.llm import chat, decontaminate, html_text, langid, licenses, merkle, mixing, packing, phrases, quality, simhash, token_files, topk

MODULES = (simhash, decontaminate, mixing, licenses, quality, token_files, langid, topk, html_text, chat, merkle, packing, phrases)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
