"""streaming of heddle."""
