"""The corpus pipeline: stages from raw documents to token ids, each a training-data operator on what the last kept."""

from __future__ import annotations

from weekpanel.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
