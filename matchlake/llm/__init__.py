"""Training-data operators. Nothing else in matchlake imports this package."""
