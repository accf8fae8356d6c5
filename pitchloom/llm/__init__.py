"""Operators for preparing training text.

Nothing outside this folder imports it: it can be deleted without touching the rest of the library.
"""
