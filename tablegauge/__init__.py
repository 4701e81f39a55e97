"""Table analytics on Spark: profiling, quality, anomalies, KPIs, features, text jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is computed until
the caller runs an action, except where a docstring says so.
"""
