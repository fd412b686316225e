"""Pure Column-expression libraries (no actions, no Python row code)."""
