"""docweave: documentation corpora as Spark tables.

HTML pages go in; endpoints, error codes, field schemas, rules, release notes and
searchable text come out as DataFrames, and further jobs query, check and track them.
"""

__version__ = "0.1.0"
