"""Training-data operators: ten document-scale operators and their queries."""
