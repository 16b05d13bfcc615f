"""The continuous stream of draws, cut into windows."""
