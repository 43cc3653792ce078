"""Column functions that stay inside the JVM, and numpy kernels for Arrow UDFs."""
