"""See README.md for the inventory of this subpackage."""
