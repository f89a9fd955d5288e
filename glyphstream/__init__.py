"""Screen-text event analytics expressed as Spark DataFrame plans."""
