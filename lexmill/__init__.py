"""lexmill: linguistic annotation and corpus analytics as Spark DataFrame plans."""
