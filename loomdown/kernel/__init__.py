"""kernel of the engine."""
