"""Column functions; JVM expressions except where a module says otherwise."""
