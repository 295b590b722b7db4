"""Document analytics as ordinary Spark plans."""
