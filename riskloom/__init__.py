"""riskloom: change-impact analytics as Spark DataFrame operators."""
