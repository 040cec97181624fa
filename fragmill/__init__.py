"""Short-read analytics as DataFrame transformations."""
