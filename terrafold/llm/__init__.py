"""Operators for preparing language-model training corpora.

Every operator lives in a module of its own; ``registry`` names the queries and
their SQL twins.  Nothing outside this subpackage imports it.
"""
