"""Queries of the analytics engine and their SQL."""

from __future__ import annotations

from tidemark.plans import chains, claims, documents, evidence, figures, intake, market, news, records, retrieval, runs, streams, structure, tasks, workbench

FLAGSHIP = "market_candidate_rank"
_ALL = {**market.QUERIES, **news.QUERIES, **retrieval.QUERIES, **claims.QUERIES, **runs.QUERIES, **documents.QUERIES, **streams.QUERIES, **records.QUERIES, **workbench.QUERIES, **intake.QUERIES, **tasks.QUERIES, **evidence.QUERIES, **structure.QUERIES, **chains.QUERIES, **figures.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
