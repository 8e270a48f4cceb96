"""Training-data operators: ten independent modules, their queries and their SQL."""
