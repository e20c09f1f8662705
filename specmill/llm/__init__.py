"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``specmill.llm.queries`` registers one query per operator.
"""
