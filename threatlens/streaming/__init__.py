"""threatlens.streaming."""
