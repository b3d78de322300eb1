"""Table discovery and analytics over a data lake, as Spark plans."""
