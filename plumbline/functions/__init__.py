"""Column-level building blocks: portable hashing, feature arrays, guarded arithmetic."""
