"""The index: creation, reconciliation, search and maintenance as whole plans."""
