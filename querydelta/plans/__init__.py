"""Multi-step reports composed from the operators."""
