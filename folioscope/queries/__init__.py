"""Queries over the driver's tables and the SQL that each is checked against."""
