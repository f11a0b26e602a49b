"""The staged, intermediate and report tables, and what is asked of them."""
