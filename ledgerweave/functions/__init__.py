"""Column functions over money, dates and statement text."""
