"""Where library tables come from and go to."""
