"""Change-point analytics on Spark: segment costs, detectors, online alerts, diagnostics and metrics over DataFrames."""
