"""Operators for preparing language-model training data at cluster scale.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
subpackage imports it; its registered queries live in ``docloom.llm.queries``.
"""
