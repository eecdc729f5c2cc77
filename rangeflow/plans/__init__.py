"""Plans: policies, the wave controller, and the catalogue of queries."""
