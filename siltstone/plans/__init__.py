"""Layer jobs and the queries run by the driver."""
