"""Generic relational operators over any DataFrame."""
