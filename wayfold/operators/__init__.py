"""Package: operators."""
