"""Index upkeep, standing rules and time buckets over streams."""
