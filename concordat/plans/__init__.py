"""End-to-end plans: several operators composed into one lazy DataFrame."""
