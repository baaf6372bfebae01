"""The jobs' building blocks; every function takes and returns DataFrames."""
