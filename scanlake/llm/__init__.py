"""Operators of a training-data pipeline: language, tokens, near copies, leaks, secrets, urls, toxicity.

Nothing outside this folder imports it; its tests are in ``tests/llm``.
"""
