"""Evidence analytics on Spark: typed facts, events, text retrieval and corpus preparation as DataFrame operators."""
