"""Training-data operators: one module per operator, plus the registered queries.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
