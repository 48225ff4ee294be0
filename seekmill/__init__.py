"""A full-text and hybrid retrieval engine whose every computation is a Spark plan."""
