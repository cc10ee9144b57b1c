"""Where tables, columns and descriptors come from, and the views that go out."""
