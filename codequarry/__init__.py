"""Search and analyse collections of text and source files as Spark tables."""
