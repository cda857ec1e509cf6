"""Scans: registry dumps, run logs, freshness records, workspaces, API documents."""
