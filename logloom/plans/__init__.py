"""The pipeline as a whole, and the registered queries."""
