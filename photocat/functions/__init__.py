"""Column functions and group helpers shared by the operators."""
