"""Where trips and zones come from, and the one schema they are brought to."""
