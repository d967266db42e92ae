"""Registered queries, one for each operator or function group, with the SQL that an independent engine answers the same way."""
