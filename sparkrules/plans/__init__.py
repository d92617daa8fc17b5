"""From rule text to a plan of columns."""
