"""Whole queries built from the operators, with the SQL that states the same."""
