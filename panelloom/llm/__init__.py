"""Operators that prepare training text at scale, and their registered queries."""
