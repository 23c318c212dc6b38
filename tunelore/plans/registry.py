"""All queries of the core, by name."""

from __future__ import annotations

from tunelore.plans import clusters, corpus, decoding, files, mapping, measurements, records, segments, sound, symbolic

_PARTS = (measurements, corpus, symbolic, records, segments, clusters, mapping, decoding, files, sound)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in _PARTS for name, q in part.SQL.items()}
