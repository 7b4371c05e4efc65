"""M5P model trees as distributed aggregations."""
