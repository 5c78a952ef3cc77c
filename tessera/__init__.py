"""tessera: coverage, track and network analytics as Spark DataFrame operators."""
