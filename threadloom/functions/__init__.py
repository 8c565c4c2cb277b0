"""Column expressions; every function is Column -> Column and stays in the JVM."""
