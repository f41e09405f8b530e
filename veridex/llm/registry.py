"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from veridex.llm import queries as q

QUERIES = {name: getattr(q, name) for name in q.NAMES}
ORACLES = q.ORACLES
