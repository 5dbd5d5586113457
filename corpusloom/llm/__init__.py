"""Training-data operators: ten DataFrame -> DataFrame operators and their contract queries."""
