"""Operators for large text corpora that feed language-model training.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library intact.
"""
