"""Operators that prepare text corpora for training; nothing else in driftwell imports this package."""
