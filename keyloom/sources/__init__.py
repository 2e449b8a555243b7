"""Files: listing, footers, staged writes."""
