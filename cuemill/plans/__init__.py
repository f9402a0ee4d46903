"""Plans that combine operators, and the queries of the core."""
