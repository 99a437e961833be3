"""From raw documents to packed training sequences; lodestone.llm.pipeline has the stages."""

from lodestone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
