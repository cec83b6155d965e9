"""Operators on the text of a training corpus; nothing outside this subpackage imports it."""
