"""The corpus pipeline over the documents; its stages are in ``basaltine.llm.pipeline``."""

from basaltine.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
