"""Join keys and physical-plan helpers: size-checked broadcast, salting, grids, terms."""
