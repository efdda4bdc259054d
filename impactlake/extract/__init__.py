"""Facts from source texts."""
