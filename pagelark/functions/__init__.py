"""Column functions: text normal forms, amounts, periods, ids and policies."""
