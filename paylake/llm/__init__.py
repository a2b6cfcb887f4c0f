"""Training-data operators: tokenised output, packing, deduplication,
decontamination, classification and audit, as Spark jobs.

Nothing outside this package imports it. Every operator is a function of
DataFrames and documented parameters; ``queries`` holds the registered
queries and their SQL.
"""
