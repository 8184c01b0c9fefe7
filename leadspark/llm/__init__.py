"""Training-data operators: thirteen jobs over documents, pages, embeddings and conversations.

Nothing else in the library imports this package. Its queries and SQL twins are in
`queries.py`.
"""
