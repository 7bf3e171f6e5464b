"""Operators that prepare text and source collections for language models."""
