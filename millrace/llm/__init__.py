"""Operators for building language-model training data, one module per operator.

Nothing outside this package imports it, except the guarded lookup in ``__spark_entry__.py``.
"""
