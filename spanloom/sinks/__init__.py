"""Writers: day-partitioned, clustered signal tables and their upkeep."""
