"""strataquery: knowledge-base analytics expressed as PySpark DataFrame plans."""
