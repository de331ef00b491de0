"""Registered queries: operators on tables, and the SQL that says the same."""
