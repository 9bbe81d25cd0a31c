"""Case-law and patent analytics as Spark DataFrame operators."""
