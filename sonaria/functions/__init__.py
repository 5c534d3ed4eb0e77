"""Column-level functions: text, vectors, audio samples, JSON messages."""
