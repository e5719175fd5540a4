"""Physical operators on points and series frames."""
