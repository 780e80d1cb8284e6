"""The pipeline over unbounded logs."""
