"""A training corpus from raw documents: the stages of the training-data subpackage, in order."""

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
