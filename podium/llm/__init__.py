"""Operators of a training-data pipeline over documents, embeddings, pages and
conversations. One module per operator; :mod:`podium.llm.queries` registers
the thin queries built on them."""
