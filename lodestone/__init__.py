"""lodestone: retrieval and corpus analytics expressed as Spark plans."""
