"""Recording-quality analytics expressed as lazy Spark DataFrame plans."""
