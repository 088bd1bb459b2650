"""Exploratory analytics over Spark DataFrames.

Every operator takes a DataFrame and returns a tidy DataFrame.  ``plans`` holds
the shared distributed kernels (exact quantiles, ranks, ordered rows, moments),
``operators`` the user-facing functions, ``sources`` readers and writers.
"""

__version__ = "0.1.0"
