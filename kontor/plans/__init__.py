"""Composite jobs (full analysis, reconcile, dashboard) and the query registry."""
