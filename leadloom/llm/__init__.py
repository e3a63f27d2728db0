"""Training-data operators over the tables documents, pages, embeddings, benchmark and labels."""
