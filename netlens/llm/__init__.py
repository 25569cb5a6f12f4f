"""Operators that prepare training data: documents, conversations, pages and embeddings."""
