"""Reading extracts, publishing derived tables, and the fixture views of the driver tables."""
