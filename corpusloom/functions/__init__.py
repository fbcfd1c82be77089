"""Scalar functions: Column expressions wherever Spark can express them, Arrow functions elsewhere."""
