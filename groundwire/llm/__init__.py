"""Training-data operators over documents, embeddings, pages and conversations. Nothing else in the
library imports this subpackage."""
