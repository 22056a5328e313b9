"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage.  Each operator module
documents its algorithm, its bounds and what it does with nulls, empty tables,
ties and repeated rows; ``queries`` registers one query per operator.
"""
