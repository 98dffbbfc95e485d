"""faultline — inspection / defect analytics expressed as Spark DataFrame plans.

Sub-packages:
  functions  shared Column / SQL-expression formulas (rates, Wilson, chi-square, scores)
  sources    readers for the canonical inspection table, CSV/union sources, sinks
  operators  the analytical operators (KPIs, trends, patterns, root cause, clustering, findings, ingest)
  plans      the registry of runnable queries and their SQL oracles
  streaming  Structured Streaming jobs over the same operators
"""

__version__ = "0.1.0"
