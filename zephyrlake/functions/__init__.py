"""Missing values and scalar expressions."""
