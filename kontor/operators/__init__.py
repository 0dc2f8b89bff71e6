"""DataFrame operators: prepare, analytics reports, reconciliation."""
