"""All registered queries of the library proper."""

from fieldlab.plans import catalogue, dataset, evaluation, quality, streams, tips

_MODULES = [catalogue, tips, quality, dataset, evaluation, streams]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
