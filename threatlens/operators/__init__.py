"""threatlens.operators."""
