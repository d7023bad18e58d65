"""Operators of a training-data pipeline: tokenizing, near-duplicate joins,
token files, quality and toxicity scoring, chat formatting, nearest
neighbours, token attribution and sequence packing.

Nothing outside this subpackage imports it.  ``queries`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains four.
"""
