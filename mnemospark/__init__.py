"""Memory analytics on Spark: episodic recall, knowledge graph, profiles and corpus operators as DataFrame plans."""
