"""Land-record analytics and corpus preparation on PySpark DataFrames."""
