"""Operators for preparing training text, each a module of its own; nothing else in the library imports this folder."""
