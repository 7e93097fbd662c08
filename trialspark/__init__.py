"""Spark-native toolkit for clinical-trial tables.

Every operator is ``DataFrame(s) -> DataFrame`` on the public Spark API; see
the README for the list and ``__spark_entry__.py`` for runnable examples.
"""
