"""Where attempt rows and kept results go."""
