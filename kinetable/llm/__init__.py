"""Operators that prepare text and web corpora for model training."""
