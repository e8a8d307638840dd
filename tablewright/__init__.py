"""Profile, clean, explain and question tables of any size with Spark."""
