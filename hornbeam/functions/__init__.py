"""See the README for what this part of hornbeam holds."""
