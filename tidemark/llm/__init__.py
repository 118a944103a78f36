"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``tidemark.llm.queries`` derives the registered
``opN_<name>`` results from them.
"""
