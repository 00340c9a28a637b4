"""Operators of a training-data pipeline over document, benchmark and
conversation tables. Nothing outside this folder imports it, except the guarded
lookup in ``__spark_entry__.py``."""
