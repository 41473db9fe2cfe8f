"""The registered queries, by family; importing this registers them."""

from . import aggregation, classification, extraction, learning, molecules, planning, ranking, scoring, selection, sources  # noqa: F401
