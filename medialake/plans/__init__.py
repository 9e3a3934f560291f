"""Plan building blocks shared by the operators, and the registry of queries."""
