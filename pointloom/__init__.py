"""pointloom: point-record analytics as Spark plans."""
