"""Column helpers: small, pure expressions that stay inside generated JVM code."""
