"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Each module holds one operator; ``queries`` registers them.
"""
