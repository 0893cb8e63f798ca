"""Operators for preparing training text: one module for each operator, and ``queries`` that applies them to whole tables."""
