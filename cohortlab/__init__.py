"""cohortlab: cohort selection, leakage-safe sampling and evaluation on Spark.

Every operator is a plain function from DataFrame to DataFrame; column names,
thresholds and sizes are parameters.
"""
