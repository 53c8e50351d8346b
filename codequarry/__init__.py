"""codequarry: analytics over collections of source code and documents, built on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame and stays lazy unless its docstring says
that it writes a table into the shared work folder first.
"""

__version__ = "0.1.0"
