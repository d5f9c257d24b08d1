"""Statistics over scored rows."""
