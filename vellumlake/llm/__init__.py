"""Training-data operators: filtering, de-duplication, tokenising, packing and scoring of text at scale."""
