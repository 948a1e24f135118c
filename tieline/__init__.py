"""tieline: professional-network analytics expressed as Spark DataFrame plans."""
