"""A PySpark engine that turns batches of short texts into cluster ids, from DataFrame operators."""
