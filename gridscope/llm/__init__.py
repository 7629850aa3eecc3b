"""Training-data operators: near-duplicates, media, mixing, licences, tokens, toxicity, chat, search, WARC, language."""
