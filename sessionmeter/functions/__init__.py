"""Column expressions: no UDFs, all inside code generation."""
