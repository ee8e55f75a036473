"""Operators on graphs, patches, codebooks, programs and token sequences."""
