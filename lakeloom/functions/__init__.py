"""Scalar functions of the SQL dialect that Spark lacks or defines otherwise, as column expressions."""
