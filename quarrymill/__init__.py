"""quarrymill: building, deduplicating, splitting, matching, scoring and auditing text-and-code corpora on Spark."""
