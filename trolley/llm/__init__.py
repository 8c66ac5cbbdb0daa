"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface and the thin ``opN_`` query over it;
``trolley.llm.catalog`` lists the queries and their SQL twins.
"""
