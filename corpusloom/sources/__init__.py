"""Tables to read and ways to write them."""
