"""Operators of the language-model data pipeline; nothing else in the library imports them."""
