"""All queries of the place engine and their SQL, keyed by operator."""

from __future__ import annotations

from . import exchanges, matching, records, reports, reviews, streams, validation

QUERIES: dict = {**reports.QUERIES, **matching.QUERIES, **validation.QUERIES, **reviews.QUERIES, **exchanges.QUERIES, **streams.QUERIES, **records.QUERIES}
ORACLES: dict = {**reports.ORACLES, **matching.ORACLES, **validation.ORACLES, **reviews.ORACLES, **exchanges.ORACLES, **streams.ORACLES, **records.ORACLES}
