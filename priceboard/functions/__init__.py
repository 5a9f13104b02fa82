"""Column functions: each takes and gives columns, and stays inside whole-stage code generation."""
