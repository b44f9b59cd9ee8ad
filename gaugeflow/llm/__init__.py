"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder imports it, and the corpus
pipeline at the repository top is its only other user.
"""
