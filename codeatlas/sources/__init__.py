"""Where code lists come from and where they are kept."""
