"""Training-data operators (text, URLs, vectors, conversations); nothing else in the library imports this package."""
