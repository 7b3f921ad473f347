"""DataFrame -> DataFrame operators over measurement tables."""
