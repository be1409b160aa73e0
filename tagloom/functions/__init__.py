"""Column functions on texts and values."""
