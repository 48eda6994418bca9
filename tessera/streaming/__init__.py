"""Nothing here needs a stream: every operator of this engine is a batch DataFrame function."""
