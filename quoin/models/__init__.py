"""Models on rows of a feature array and a target."""
