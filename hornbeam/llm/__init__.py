"""Operators for preparing training text. Nothing else in hornbeam imports this subpackage."""
