"""End-to-end jobs and the registered queries."""
