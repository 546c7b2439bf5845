"""Gates, repair and measurement of semi-structured artifacts on Spark."""
