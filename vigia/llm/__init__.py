"""Operations of a training-data pipeline: quality, tokens, mixing, links, duplicates, shards, toxicity."""
