"""Named queries and their SQL oracles."""
