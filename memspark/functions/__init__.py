"""Column functions: text, routing, extraction and the compact dialect."""
