"""Column functions: text normalisation, structured extraction, string similarity."""
