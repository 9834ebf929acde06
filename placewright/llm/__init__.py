"""Operators for large training corpora: tokens, duplicates, archives, quality, mixing."""
