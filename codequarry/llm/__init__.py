"""Operators that prepare collections of text and code for training language models.

Nothing outside this subpackage imports it; its queries are added by ``__spark_entry__`` when it is present.
"""
