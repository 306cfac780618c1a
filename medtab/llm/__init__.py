"""Training-data operators: scoring, search, dedup, mixing and binary token output over document tables."""
