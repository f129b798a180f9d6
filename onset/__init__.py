"""First-appearance dating over irregular, noisy series, as Spark plans."""
