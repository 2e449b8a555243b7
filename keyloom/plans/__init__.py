"""Where mutations fall, and what a rewrite will do."""
