"""All queries of the core package with their SQL counterparts."""

from __future__ import annotations

from cueloom.plans import intervals, matching, merging, recordings, transcripts

FLAGSHIP = "vtt_render"
_MODULES = [recordings, matching, transcripts, merging, intervals]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
