"""graphloom: graph-pattern analytics and training-data operators on PySpark."""
