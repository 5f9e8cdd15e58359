"""Tables as lazy plans, and the workspace that holds them."""
