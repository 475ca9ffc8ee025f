"""Detection, validation and reversible pseudonymisation of personal data on Spark DataFrames."""
