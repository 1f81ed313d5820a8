"""Operators for preparing large text and vector corpora for training.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` binds them to the driver's tables.
"""
