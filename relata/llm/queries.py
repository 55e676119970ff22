"""Importing this module registers the queries of all operators."""

import corpus_pipeline  # noqa: F401
from relata.llm import (  # noqa: F401
    bilinear,
    chat,
    copies,
    decontaminate,
    jaccard,
    linechunks,
    mixing,
    pages,
    periodic,
    quality,
    sanitise,
    substrings,
    turns,
)
from relata.llm.registry import ORACLES, QUERIES  # noqa: F401
