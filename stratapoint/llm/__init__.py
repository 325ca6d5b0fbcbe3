"""Operators on texts. Nothing else in the package imports this one."""
