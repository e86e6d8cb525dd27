"""All registered queries."""

from pairgrammar.queries import expressions, metrics, motifs, plans, relations, sources, splits, summaries  # noqa: F401
from pairgrammar.queries.registry import ORACLES, QUERIES  # noqa: F401
