"""Operators for large training-data corpora.

Nothing outside this folder imports it; the rest of the library works without it.
Every operator takes and returns DataFrames and keeps its own general interface; the
``opN_<name>`` queries in :mod:`vastgrain.llm.queries` are thin digests over them.
"""
