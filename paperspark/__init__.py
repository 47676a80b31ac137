"""paperspark: search a corpus of scientific papers with Spark DataFrames.

Read NDJSON metadata into typed tables (with a quarantine for bad lines),
index papers by primary category and latest revision time, select them,
keep keyed tables of summaries and vectors with upsert / insert-if-absent /
compute-only-what-is-missing semantics, run user text functions in Arrow
batches, and answer questions by exact nearest-neighbour retrieval plus
ranked context assembly.
"""

__version__ = "0.1.0"
