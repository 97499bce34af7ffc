"""Column functions: spans, checksums, text folding. JVM expressions unless a docstring says otherwise."""
