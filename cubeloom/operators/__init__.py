"""Analysis operators: each takes cube tables and returns a lazy DataFrame."""
