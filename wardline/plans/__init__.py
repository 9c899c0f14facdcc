"""Queries over the driver tables, and their SQL."""

from . import detect_queries, entity_queries, more_queries, report_queries, scan_oracles, scan_queries, sequence_oracles, stored_queries

QUERIES = {**scan_queries.QUERIES, **detect_queries.QUERIES, **report_queries.QUERIES, **more_queries.QUERIES, **entity_queries.QUERIES, **stored_queries.QUERIES}
ORACLES = {**scan_oracles.ORACLES, **detect_queries.ORACLES, **report_queries.ORACLES, **more_queries.ORACLES, **entity_queries.ORACLES, **sequence_oracles.ORACLES, **stored_queries.ORACLES}
