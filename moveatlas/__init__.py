"""Human-mobility analytics as composable PySpark DataFrame operators."""
