"""Column functions: cleaning, calendar and spec features, display text."""
