"""lodestone: code-evidence analytics as composable PySpark DataFrame operators."""
