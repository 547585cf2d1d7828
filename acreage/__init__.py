"""acreage — property-market analytics as plain Spark DataFrame operators.

Sub-packages
------------
sources    readers, literal decoding, incremental upsert, HTML field extraction
functions  Column-level parsers and text helpers (pure expressions, no actions)
operators  DataFrame -> DataFrame operators: rules, imputation, statistics, views,
           features, similarity, pricing insight, plus the distributed ordered primitives
ml         Spark ML jobs: splits, encoders, metrics, fits, tuning, registry
plans      bindings of the operators to the driver tables and the registered queries
streaming  Structured Streaming wrappers (foreachBatch upsert, streaming scoring)
"""

__version__ = "0.1.0"
