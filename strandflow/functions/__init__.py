"""Column functions over source text: margins, token classes, names and literals."""
