"""Column helpers that reproduce Python text semantics inside the JVM."""
