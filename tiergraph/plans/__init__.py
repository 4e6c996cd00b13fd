"""Query plans: the driver-facing catalogue, refresh and persistence."""
