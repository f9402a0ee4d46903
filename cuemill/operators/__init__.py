"""Operators on tables of lines, cues, sentences, segments and texts."""
