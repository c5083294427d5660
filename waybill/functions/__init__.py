"""Column functions of booking records."""
