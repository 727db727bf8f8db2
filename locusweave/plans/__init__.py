"""User-visible modes as compositions of operators."""
