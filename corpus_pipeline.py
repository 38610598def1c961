"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, BPE ids."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
