"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; it uses nothing of the
event-revision engine either, so both can be shipped alone.
"""
