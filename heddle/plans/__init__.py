"""plans of heddle."""
