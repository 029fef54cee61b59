"""Jobs that run from a command line or within a session."""
