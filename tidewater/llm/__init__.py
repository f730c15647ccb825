"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it registers its own
queries through :mod:`tidewater.llm.registry`.
"""
