"""Column expressions; all JVM-side except the nested-comment helper in ``statements``."""
