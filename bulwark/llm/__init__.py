"""Training-data operators: classifiers, near-duplicates, tokens, language models, mixing, secrets."""
