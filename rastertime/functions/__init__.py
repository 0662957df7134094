"""Column expressions: band algebra, indices, masks, harmonisation, segment and model arrays."""
