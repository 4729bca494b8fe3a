"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pathfold.llm import bpe, jaccard, kneser_ney, langid, licenses, mixing, radix_dedup, suffix_dedup, tiff, toxicity

MODULES = (licenses, mixing, bpe, kneser_ney, radix_dedup, suffix_dedup, tiff, toxicity, jaccard, langid)

QUERIES = {m.QUERY: m.query for m in MODULES}
SQL = {m.QUERY: m.SQL for m in MODULES if m.SQL}
