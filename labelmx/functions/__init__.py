"""Column expressions used by the operators; all run inside the JVM."""
