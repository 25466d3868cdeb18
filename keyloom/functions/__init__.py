"""keyloom."""
