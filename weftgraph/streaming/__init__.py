"""Empty on purpose: the engine matches static graphs, and no operator of its inventory is a stream."""
