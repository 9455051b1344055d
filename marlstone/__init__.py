"""Marlstone: data mining and rule analytics on PySpark DataFrames."""
