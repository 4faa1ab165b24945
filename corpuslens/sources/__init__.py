"""Where corpora come from and where results go."""
