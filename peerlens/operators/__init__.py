"""DataFrame operators; each module states its null, tie and empty-input rules."""
