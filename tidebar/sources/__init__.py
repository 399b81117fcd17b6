"""Where bars and ticks come from, and where they go."""
