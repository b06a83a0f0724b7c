"""Part of the library; see the README for an overview."""
