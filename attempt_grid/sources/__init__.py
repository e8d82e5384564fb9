"""Where attempt rows come from."""
