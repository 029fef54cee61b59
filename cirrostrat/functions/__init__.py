"""Column functions: all run in the JVM as expressions."""
