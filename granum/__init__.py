"""granum: a library of named analytical operators over Spark DataFrames.

Every operator is a pure function from DataFrames to a DataFrame; the caller owns
the session.  ``granum.plans`` binds operators to tables as named queries.
"""
