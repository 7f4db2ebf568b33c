"""Operators for preparing text and vector corpora for model training.

Nothing else in the library imports this subpackage.
"""
