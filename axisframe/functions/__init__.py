"""Column functions and NumPy kernels without Spark state."""
