"""Training-data operators: tokenising, fingerprints, archives, joins, filters and mixing."""
