"""Operators for preparing training text, sound made of text and conversations.

Nothing outside this folder imports it. ``queries.py`` registers one query for
each operator; ``corpus_pipeline.py`` at the top of the repository chains five.
"""
