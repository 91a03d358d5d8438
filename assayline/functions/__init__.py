"""Column helpers, scratch tables and graph helpers shared by the operators."""
