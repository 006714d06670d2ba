"""Source-statistics engine expressed as Spark plans."""
