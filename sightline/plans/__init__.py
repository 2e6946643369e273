"""Stage graph, the derived domain over the driver's tables, and the queries."""
