"""DataFrame operators on the graph tables and result rows."""
