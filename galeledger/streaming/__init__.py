"""The news job on newly landed files."""
