"""traceloom: behavioural fingerprints, similarity search and skew-safe aggregation on Spark DataFrames.

Layout
------
``functions``  column expressions and their numpy twins (hashing, effects, signatures, escaping)
``operators``  DataFrame -> DataFrame building blocks (matching, access logs, skew-safe aggregation, ...)
``sources``    corpus tables, SQLite images, ELF files
``plans``      user-facing reports composed of operators (index, match, query, triage, evaluate, dump)
``streaming``  incremental fingerprints for Structured Streaming
``llm``        operators for training-data pipelines; nothing outside this subpackage imports it
"""

__version__ = "0.1.0"
