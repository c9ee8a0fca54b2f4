"""Expressions and the fluent query builder."""
