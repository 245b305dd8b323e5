"""Column functions; all of them are Catalyst expressions."""
