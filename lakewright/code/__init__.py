"""Source code: symbols, docstrings, signatures."""
