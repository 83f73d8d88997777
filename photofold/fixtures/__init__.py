"""The engine's tables derived from the given test tables, in Spark and in SQL."""
