"""Part of shelfspark."""
