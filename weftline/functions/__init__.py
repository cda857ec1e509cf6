"""Column functions: hashes, paths, names, versions, links and texts."""
