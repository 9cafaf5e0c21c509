"""The pipeline of the text operators, from raw documents to a training corpus."""

from __future__ import annotations

from terrafold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
