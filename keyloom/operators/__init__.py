"""Relations and what can be done to them."""
