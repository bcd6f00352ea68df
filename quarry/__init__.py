"""quarry: code-structure analytics expressed as Spark DataFrame plans."""
