"""Language data and sources of embeddings and requests."""
