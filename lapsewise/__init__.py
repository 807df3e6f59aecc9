"""lapsewise: customer-retention analytics as lazy Spark DataFrame plans.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except bounded vocabularies and one-row parameters.
"""

__version__ = "0.1.0"
