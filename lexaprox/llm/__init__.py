"""Operators for preparing training corpora.

Nothing outside this subpackage imports it: it can be deleted as a whole.
"""
