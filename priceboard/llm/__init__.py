"""Training-data operators over tables of documents.  Nothing else in the library imports this."""
