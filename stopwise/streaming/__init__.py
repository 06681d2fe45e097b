"""Incremental refresh of the reports."""
