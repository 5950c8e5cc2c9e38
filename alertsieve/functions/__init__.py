"""Column functions: probability vectors, sets, ticket fields, explanations."""
