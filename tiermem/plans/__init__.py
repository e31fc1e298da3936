"""Canonical streams from the driver's tables, the registered queries over them, and the SQL that states the same."""
