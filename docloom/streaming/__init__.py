"""Log and stream jobs."""
