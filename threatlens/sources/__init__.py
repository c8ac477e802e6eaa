"""threatlens.sources."""
