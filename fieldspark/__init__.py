"""fieldspark: plant-level field data and training-corpus operators as Spark DataFrames."""
