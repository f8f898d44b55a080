"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``common`` the helpers that the operators share.
"""
