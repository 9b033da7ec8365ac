"""Steps that are found by looking through this package."""
