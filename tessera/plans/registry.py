"""All queries of the engine and their SQL."""

from __future__ import annotations

from tessera.plans import analytics, files, learning, streams, text

QUERIES = {**text.QUERIES, **learning.QUERIES, **analytics.QUERIES, **streams.QUERIES, **files.QUERIES}
SQL = {**text.SQL, **learning.SQL, **analytics.SQL, **streams.SQL, **files.SQL}
