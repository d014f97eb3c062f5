"""sources of heddle."""
