"""Training-data operators: each works on a whole table of texts, pages or media."""
