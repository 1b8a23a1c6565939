"""Content and assessment analytics as DataFrame operators."""
