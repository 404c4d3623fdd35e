"""methloom: a Spark-native engine for DNA-methylation site tables.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
unless the docstring says so and names the bound.
"""

__version__ = "0.1.0"
