"""Operators for preparing text for language-model training, and their registered queries."""
