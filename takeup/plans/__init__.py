"""Stand-in tables, registered queries and the end-to-end chain."""
