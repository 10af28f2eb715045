"""Training-data operators; nothing else in bizframe imports this subpackage."""
