"""Operators that prepare subtitles, transcripts and documents as training data.

Nothing outside this package imports it; ``queries.py`` lists its queries.
"""
