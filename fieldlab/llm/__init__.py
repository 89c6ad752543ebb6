"""Training-data operators: thirteen self-contained Spark jobs over text corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface plus the thin ``opN_*`` query over it;
``QUERIES`` and ``ORACLE_SQL`` collect them for ``__spark_entry__``.
"""
