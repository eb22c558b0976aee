"""Operators of a training-data pipeline. Nothing outside this folder, tests/llm and corpus_pipeline.py imports it."""
