"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may be deleted as a
whole.  ``queries`` holds the registered queries, one module per operator holds
the operator itself.
"""
