"""Column functions: pure expressions that stay inside Catalyst."""
