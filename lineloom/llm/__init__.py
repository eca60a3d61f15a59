"""Preparation of training data: near-duplicates, nearest neighbours, licences, chats, tokens, quality, mixing, toxicity."""
