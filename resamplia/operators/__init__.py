"""DataFrame-to-DataFrame building blocks: draws, weights, ordered prefixes, checks."""
