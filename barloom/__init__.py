"""barloom: a PySpark engine for research on bar time series.

Every operator is a ``DataFrame -> DataFrame`` function keyed by
``(symbol, timeframe[, run, fold, ...])`` so that a whole research matrix is
one distributed job.
"""
