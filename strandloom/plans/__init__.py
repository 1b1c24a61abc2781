"""Planning: strategy choice, lineage cuts, output formats."""
