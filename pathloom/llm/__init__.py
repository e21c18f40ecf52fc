"""Operators for preparing text and ranked results for training corpora; nothing outside uses them."""
