"""Relational operators over edge relations."""
