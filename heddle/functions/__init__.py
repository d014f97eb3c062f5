"""functions of heddle."""
