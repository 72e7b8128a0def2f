"""Reading and writing tables, lists and scores."""
