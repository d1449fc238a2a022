"""Views over the driver's tables, and the query catalogue."""
