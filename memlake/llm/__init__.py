"""Training-data operators: licences, extraction, secrets, search, packing, tokens, near copies, quality, personal data."""
