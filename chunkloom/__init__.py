"""Late chunking as Spark plans: sentences, tokens, sequences, chunk windows, pooled embeddings, search."""
