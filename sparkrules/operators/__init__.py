"""DataFrame operators: windows, lookups, models, decisions, backtests and monitoring."""
