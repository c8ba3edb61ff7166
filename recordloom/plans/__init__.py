"""End-to-end plans and the queries registered for checking against SQL."""
