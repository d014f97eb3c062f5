"""operators of heddle."""
