"""Input tables and upserts."""
