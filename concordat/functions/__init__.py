"""Column functions: everything here is native and stays inside code generation."""
