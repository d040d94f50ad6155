"""Column expressions shared by the operators, and the fixed values they use."""
