"""Scalar functions as column expressions; Arrow UDFs only where no built-in function can do it."""
