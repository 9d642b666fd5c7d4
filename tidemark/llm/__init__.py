"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_*`` queries; every other module is one operator with its own interface.
"""
