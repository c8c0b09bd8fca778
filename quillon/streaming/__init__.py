"""Change streams: reading, replaying, triggers and running state."""
