"""tessera: tabular-learning analytics as DataFrame-to-DataFrame operators on Spark."""
