"""Tables, change feeds, key-value stores and snapshots."""
