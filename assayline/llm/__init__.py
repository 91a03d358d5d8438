"""Operators for preparing text corpora for training; nothing outside imports this subpackage."""
