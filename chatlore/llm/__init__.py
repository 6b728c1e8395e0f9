"""Training-data operators (one module each) and their registered queries.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds ``queries.QUERIES`` when it is present."""
