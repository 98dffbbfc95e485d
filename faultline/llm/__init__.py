"""Operators for preparing language-model training text at corpus scale."""
