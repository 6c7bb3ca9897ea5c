"""Operators on texts for language-model corpora. Nothing outside this subpackage imports it."""
