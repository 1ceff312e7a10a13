"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Common rules. Operators read only the columns they name, so further columns, whatever they are called, change nothing.
A null text counts as empty. A null id counts as the empty string where an id is hashed, and is returned as null. Rows
that repeat each give a row. An empty table gives an empty result with the same columns.
"""
