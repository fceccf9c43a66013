"""Column -> Column building blocks. All of them stay on the JVM."""
