"""Market-signal analytics and training-data operators on Spark."""
