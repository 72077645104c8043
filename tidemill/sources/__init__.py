"""Reading, checking and writing bars, signals and results."""
