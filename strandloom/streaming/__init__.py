"""Per-entry operators on streams of entries."""
