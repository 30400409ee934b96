"""lakeweave: governed lakehouse data work as Spark DataFrame operators."""
