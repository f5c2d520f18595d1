"""lodex: a Spark-first index, search and freshness engine for code and document corpora."""
