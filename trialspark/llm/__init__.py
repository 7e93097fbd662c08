"""Operators that prepare text for training language models.

Each module holds one operator with its own general interface; ``queries`` binds
them to the sample tables. Nothing outside this subpackage imports it.
"""
