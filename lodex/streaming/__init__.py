"""Fresh indexes from streams of file events."""
