"""Column functions. Every function takes and returns columns and stays inside the JVM."""
