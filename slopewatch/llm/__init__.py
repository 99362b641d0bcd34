"""Operators for preparing language-model training text: each is a Spark job over the synthetic text tables."""
