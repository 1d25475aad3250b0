"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

from . import assembly, client, content, documents, figures, further, matching, relational, service, storage

PARTS = (relational, storage, content, documents, assembly, service, further, client, matching, figures)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
