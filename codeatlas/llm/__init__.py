"""Training-data operators: ten Spark jobs over documents, pages and conversations.

Nothing outside this folder imports it.  ``queries.QUERIES`` and ``queries.ORACLES``
hold what ``__spark_entry__`` registers.
"""
