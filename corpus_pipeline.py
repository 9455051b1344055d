"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, SentencePiece.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame. run(spark, sf_dir) applies them to documents. ORACLE_SQL is None, as SQL can't
express them. All of it is in marlstone.llm.pipeline, without which this module can't be imported.
"""

from marlstone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
