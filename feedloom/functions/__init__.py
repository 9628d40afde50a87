"""Column functions: text, numbers, URLs, hashes, encodings, CSV text."""
