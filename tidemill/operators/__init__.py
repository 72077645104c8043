"""Operators on panels of bars.  Keys of a panel always include the symbol; each combination of keys is one ordered run."""
