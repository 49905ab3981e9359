"""Pure Column builders: no actions, no state."""
