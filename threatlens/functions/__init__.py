"""threatlens.functions."""
