"""The catalogue: every query by name, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from . import documents, relational

QUERIES = {**relational.QUERIES, **documents.QUERIES}
ORACLES = {**relational.ORACLES, **documents.ORACLES}
