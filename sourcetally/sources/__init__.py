"""Inputs (file tables, raw trees, dictionaries) and the result sink."""
