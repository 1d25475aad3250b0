"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; ``docflow.llm.queries`` holds the
registered queries and ``docflow.llm.sql`` their DuckDB counterparts.
"""
