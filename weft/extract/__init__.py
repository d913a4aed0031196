"""Source text to facts (one file at a time), facts to nodes and edges (joins)."""
