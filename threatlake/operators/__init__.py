"""DataFrame operators; each takes any DataFrame plus column names."""
