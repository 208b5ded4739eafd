"""DataFrame -> DataFrame operators; every one of them returns a lazy plan."""
