"""Training-data operators: thirteen corpus operators as Spark jobs.

Nothing outside this package imports it; the registered queries live in
``queries.py``.
"""
