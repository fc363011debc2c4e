"""Named queries over the synthetic binding, each with its equivalent in DuckDB SQL where SQL has one."""

from __future__ import annotations

from . import cleaning, incremental, matching, modelling, parsing, publishing, ranking, textual, views

PARTS = (views, ranking, matching, cleaning, textual, incremental, modelling, publishing, parsing)
QUERIES = {k: f for m in PARTS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in PARTS for k, s in m.ORACLES.items()}
