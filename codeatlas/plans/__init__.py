"""The canonical schema and the service over it."""
