"""Where event logs come from and go to."""
