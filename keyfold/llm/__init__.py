"""Operators on training text. Nothing outside this folder and its tests imports it."""
