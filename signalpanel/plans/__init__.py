"""Named queries over the shared tables, with their reference SQL."""
