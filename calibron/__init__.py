"""calibron: adaptive measurement analytics expressed as Spark DataFrame programs."""
