"""Operators for building training corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator with a
general interface; :mod:`tidelog.llm.queries` binds the operators to the tables of a corpus
folder.
"""
