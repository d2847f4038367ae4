"""Operators: evidence, vector, text, hybrid, evaluation, usage."""
