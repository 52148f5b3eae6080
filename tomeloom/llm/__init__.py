"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Queries and oracle SQL are in
``tomeloom.llm.queries``; the multi-stage pipeline is ``corpus_pipeline.py`` at the
repository top.
"""
