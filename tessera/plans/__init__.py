"""Commands, and the registered queries with their oracles."""
