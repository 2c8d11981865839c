"""Column-expression helpers: column classes, missing values, text classes,
statistical special functions."""
