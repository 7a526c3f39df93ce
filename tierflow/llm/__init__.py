"""Operators for preparing language-model training data.

Each module holds one operator with its own interface; `queries` registers them over whole tables.
"""
