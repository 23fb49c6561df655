"""Content analytics on Spark: listing, search, nested documents, text clean-up and editorial state as DataFrame jobs."""
