"""Operators for preparing large training corpora; nothing outside this subpackage imports it."""
