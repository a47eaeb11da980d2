"""Query plans that compose operators over the tables."""
