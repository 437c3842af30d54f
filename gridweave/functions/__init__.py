"""Column functions: every one is built from Spark SQL functions and stays in the JVM."""
