"""Contributor-journey analytics on Spark: table-to-table operators over commits, timelines, threads and series.

operators/  the operators, by family; each takes and returns DataFrames
functions/  column expressions that several families share
sources/    schemas, readers and writers
plans/      views of the driver's tables, and the registered queries with their SQL
llm/        operators for training data; independent of everything above
"""
