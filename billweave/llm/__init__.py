"""Operators for preparing training text: similarity, privacy, toxicity, tokens and more."""
