"""gridloom: exploring, cleaning and combining tables with PySpark DataFrames."""
