"""Training-data operators: counting, dedup, scoring, filtering, formatting, mixing."""
