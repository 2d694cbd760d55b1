"""Operators for preparing text corpora at scale. Nothing else in the package imports this one."""
