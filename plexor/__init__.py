"""plexor: multiplex-graph analytics expressed as Spark DataFrame plans."""
