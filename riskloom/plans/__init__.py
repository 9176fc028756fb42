"""End-to-end jobs, and the queries registered on the driver tables."""
