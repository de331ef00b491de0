"""Operators for preparing training text, and their registered queries.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` uses it.
"""
