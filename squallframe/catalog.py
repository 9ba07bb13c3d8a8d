"""All registered queries on storm observations, with their oracle SQL."""

from __future__ import annotations

from squallframe.operators import composites, guidance, motion, observing, outlines, passages, policies, rasters, storms, systems, timing, topics, tracking, verification  # noqa: F401  (they register their queries)
from squallframe.streaming import frames, regions, state, windows, writes  # noqa: F401  (the same)

QUERIES: dict = {**observing.QUERIES}
ORACLES: dict = {**observing.ORACLES}
