"""Operators for preparing large text corpora; nothing else in the library depends on them."""
