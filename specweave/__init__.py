"""specweave: aligned-spectra preparation expressed as Spark DataFrame jobs.

Sub-packages:
  functions  column expressions (tokenising, float parsing, peaks)
  operators  DataFrame -> DataFrame operators (rules, joins, metrics, runs)
  sources    scans and sinks (aligned text, Parquet, JSON, binary files)
  plans      composite jobs and the query registry
  streaming  Structured Streaming counterparts
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
