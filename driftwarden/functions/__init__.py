"""Column expressions. Everything here stays inside the JVM; there are no Python UDFs."""
