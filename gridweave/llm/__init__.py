"""Operators for the preparation of training text. Nothing outside this subpackage imports it."""
