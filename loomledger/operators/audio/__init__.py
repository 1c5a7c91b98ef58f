"""Speech planned, checked and mixed."""
