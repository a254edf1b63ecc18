"""corvane: corpus and call-graph analytics expressed as Spark plans."""
