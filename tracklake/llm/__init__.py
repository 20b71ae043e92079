"""Operations of a training-data pipeline: filtering, deduplication, packing, tokens, search, extraction."""
