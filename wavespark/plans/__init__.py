"""Expressions and derived signals: text to Column to change log."""
