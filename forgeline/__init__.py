"""forgeline: manufacturing analytics and training-data operators on PySpark."""
