"""Every query by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from corpusloom.operators import analytics, answers, base_graph, concepts, context, graph, learner, lifecycle, nested, papers, quiz, recommend, retrieval, study, text
from corpusloom.streaming import ingest, streams

MODULES = (analytics, learner, retrieval, concepts, text, graph, base_graph, quiz, recommend, nested, papers, context, lifecycle, study, answers, streams, ingest)
FLAGSHIP = retrieval.bm25_topk
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
