"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` derives the result
columns of the registered ``opN_`` queries from them.
"""
