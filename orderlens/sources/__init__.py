"""Where data comes from and where it is kept."""
