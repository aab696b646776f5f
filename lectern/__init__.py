"""lectern: passage-anchored retrieval and corpus analytics on Spark."""
