"""Operators for preparing text corpora for language-model training.

Each module holds one operator with a general interface; ``entry.py`` holds
the thin registered queries. Nothing outside this subpackage imports it.
"""
