"""Column functions: time formats, value functions, bases."""
