"""Column builders; every function takes Columns (or column names) and returns a Column."""
