"""Column functions: each works within a row and needs no shuffle."""
