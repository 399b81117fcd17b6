"""The same operators over growing data."""
