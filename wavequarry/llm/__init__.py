"""Operators for preparing training text, each with its query in :mod:`wavequarry.llm.queries`."""
