"""DataFrame operators; each takes tables and a policy and returns a table."""
