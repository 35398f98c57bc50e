"""DataFrame -> DataFrame operators; the same functions serve batch and streaming."""
