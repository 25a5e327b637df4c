"""Operators for preparing training text at scale.

Nothing outside this folder imports it. Each module holds one operator with its
general interface; ``queries`` holds the thin registered queries.
"""
