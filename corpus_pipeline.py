"""The corpus pipeline at the repository's top; its stages are in rillstore.llm.pipeline, with which this file goes."""

from rillstore.llm.pipeline import NEAR_BITS, STAGES, run

#: SQL cannot express zstandard, SimHash or BPE stages; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None

__all__ = ["NEAR_BITS", "ORACLE_SQL", "STAGES", "run"]
