"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` registers one thin query per operator.
"""
