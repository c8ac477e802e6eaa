"""threatlens.plans."""
