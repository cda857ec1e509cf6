"""Keyed state: status events, leases and incremental indexes, as streams with batch twins."""
