"""Operators for preparing training data: chats, packing, cleaning, near-duplicates, tokens, filters, shards."""
