"""Table contracts, readers, writers and the shared staging area."""
