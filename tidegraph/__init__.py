"""Graph, recommender and ETL operators on PySpark DataFrames."""
