"""Registered queries over the fixture tables: each has a Spark plan and, where expressible, a DuckDB twin."""
