"""Live twins of the ordered operators, and windows with watermarks."""
