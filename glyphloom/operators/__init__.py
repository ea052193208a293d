"""Tokenizers, token streams and next-token models as DataFrame operators."""
