"""Network-flow security analytics as plain functions from DataFrame to DataFrame."""
