"""Training-data operators: ten numbered operators over documents and pages, and their queries."""
