"""Part of calibron; see README.md."""
