"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder, ``corpus_pipeline.py`` and
``tests/llm`` imports it, and it imports nothing from the rest of the package.
"""
