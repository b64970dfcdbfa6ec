"""All queries of this subpackage; importing this module registers them."""

from folkscope.llm import (  # noqa: F401
    bpe,
    chat,
    codes,
    decontaminate,
    lexical,
    mixing,
    quality,
    secrets,
    simhash,
    substrings,
    tokens,
    topk,
    warc,
)
from folkscope.llm.registry import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
