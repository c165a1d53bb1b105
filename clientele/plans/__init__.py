"""End-to-end refresh and the registered queries."""
