"""Column-to-column functions; all stay inside the JVM."""
