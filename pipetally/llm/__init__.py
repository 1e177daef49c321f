"""Training-data operators.  Nothing outside this subpackage imports it.

Each module holds one operator with a general interface, plus the thin query that
applies it to the whole of its intended table; ``registry`` gathers the queries.
"""
