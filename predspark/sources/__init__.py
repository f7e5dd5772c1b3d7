"""Where values come from: Python values, JSON text, columns."""
