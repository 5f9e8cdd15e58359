"""Expressions that operators are made of."""
