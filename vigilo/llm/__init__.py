"""Operators for building language-model training corpora.

Nothing else in the library imports this package. Its queries are in
:mod:`vigilo.llm.queries`; the corpus pipeline is ``corpus_pipeline.py`` at
the repository top.
"""
