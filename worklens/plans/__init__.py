"""End-to-end jobs and the parameterised queries served from their results."""
