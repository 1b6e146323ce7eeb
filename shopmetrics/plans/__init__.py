"""Reports. Each takes DataFrames, an explicit ``as_of`` where it needs a date, and returns lazy frames."""
