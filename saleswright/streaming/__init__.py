"""Event-time service-level aggregates, for batch frames and streams alike."""
