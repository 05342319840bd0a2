"""The three jobs that chain the operators."""
