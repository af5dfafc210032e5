"""Jobs that run from the command line; their work is in functions that take a session."""
