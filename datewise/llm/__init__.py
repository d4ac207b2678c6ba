"""Operators for preparing language-model training data at corpus scale.

Nothing else in the package imports this folder. `queries.py` holds the thin
contract queries; every other module is one operator with its own interface.
"""
