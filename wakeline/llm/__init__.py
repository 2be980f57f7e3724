"""Training-data pipeline operators; the rest of the package never imports this one."""
