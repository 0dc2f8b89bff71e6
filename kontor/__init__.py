"""kontor: sales-ledger analytics and marketplace-export reconciliation on Spark.

Sub-packages:
  sources    -- landed JSON documents, CSV export grids, sinks, adapter views
  functions  -- column expressions (cleaning, calendar labels, bins, lookups)
  operators  -- DataFrame operators (prepare, analytics reports, reconciliation)
  plans      -- composite jobs and the query registry used by __spark_entry__
  streaming  -- incremental landing of document batches with Structured Streaming
"""

__version__ = "0.1.0"
