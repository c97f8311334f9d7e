"""Empty on purpose: every operator of this library is a batch plan."""
