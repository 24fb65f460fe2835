"""A corpus made ready for training: five stages over ``documents``, see ``recallspark/llm/pipeline.py``."""

from recallspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
