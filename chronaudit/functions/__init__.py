"""Column expressions on dates and text; every one stays inside the JVM."""
