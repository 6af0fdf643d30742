"""Named queries with their SQL twins, and checks on physical plans."""
