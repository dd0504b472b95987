"""Knowledge-graph and document analytics as Spark plans."""
