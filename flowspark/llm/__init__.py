"""Operators that prepare text corpora for training: one module for each, and ``queries`` that applies them to the test tables."""
