"""termweave: full-text search, term graphs and related analytics as Spark plans."""
