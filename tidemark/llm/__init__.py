"""Operators for preparing training data at corpus scale; nothing else in tidemark imports this package."""
