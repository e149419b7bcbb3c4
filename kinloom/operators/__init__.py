"""Relational operators over panels, segments and features."""
