"""Column expressions: time, money, model names and prices, classification."""
