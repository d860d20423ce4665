"""Several operators in one plan."""
