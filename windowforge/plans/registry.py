"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from windowforge.plans import arrays, collections, datasets, events, files, rows

_MODULES = (events, datasets, collections, arrays, files, rows)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()} | {"evaluation": datasets.ORACLE["metrics"]}
