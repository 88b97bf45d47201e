"""Column functions: cleaning, lexicon, transliteration, features, similarity."""
