"""Column functions: text, lexicon, scoring, vectors."""
