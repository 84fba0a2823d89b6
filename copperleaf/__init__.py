"""Creative-performance and corpus analytics as composable PySpark DataFrame operators."""
