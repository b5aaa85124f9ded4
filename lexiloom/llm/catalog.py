"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from lexiloom.llm import bpe, mixing, ngram_join, pii, quality_rules, quality_score, secrets, spotsigs, token_counts, warc

MODULES = (secrets, quality_score, token_counts, quality_rules, ngram_join, pii, warc, bpe, spotsigs, mixing)
QUERIES = {m.NAME: m.query for m in MODULES}
ORACLES = {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
