"""Column functions that stay in the JVM."""
