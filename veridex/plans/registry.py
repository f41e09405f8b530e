"""Queries over the driver tables and their SQL oracles."""

from veridex.plans import build_queries, content_queries, curation_queries, dataset_queries, metric_queries, oracles, round_queries, source_queries, stream_queries, text_queries

QUERIES = {**metric_queries.QUERIES, **text_queries.QUERIES, **curation_queries.QUERIES, **dataset_queries.QUERIES, **build_queries.QUERIES, **round_queries.QUERIES, **content_queries.QUERIES, **stream_queries.QUERIES, **source_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **text_queries.ORACLES, **curation_queries.ORACLES, **dataset_queries.ORACLES, **build_queries.ORACLES, **round_queries.ORACLES, **content_queries.ORACLES, **stream_queries.ORACLES, **source_queries.ORACLES}
