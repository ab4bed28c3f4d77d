"""The registered queries with their SQL oracles, one module per family."""
