"""Memory retrieval and corpus analytics as Spark DataFrame operators."""
