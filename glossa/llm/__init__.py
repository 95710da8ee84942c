"""Training-data operators: cleaning, matching, searching and mixing text corpora."""
