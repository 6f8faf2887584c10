"""Every query of this subpackage, by name."""

from rollcall.llm import (  # noqa: F401
    alignment,
    hnsw,
    language_id,
    language_model,
    licenses,
    mixing,
    packing,
    quality_gam,
    quality_rules,
    runs,
    simhash,
    toxicity,
    warc,
)
from rollcall.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
