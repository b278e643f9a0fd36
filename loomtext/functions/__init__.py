"""Column functions: text, script conversion, morphology."""
