"""leadloom: lead analytics as PySpark DataFrame operators."""
