"""The corpus pipeline of ``wayline.llm.pipeline``."""

from __future__ import annotations

from wayline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
