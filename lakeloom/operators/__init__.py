"""Relational operators that Spark lacks, composed of DataFrame operations."""
