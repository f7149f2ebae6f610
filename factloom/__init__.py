"""Dataset-level Spark jobs over notes, annotations, facts, dictionaries and rules."""
