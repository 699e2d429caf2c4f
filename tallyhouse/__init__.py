"""Order and sales analytics on Spark DataFrames.

Every public function takes DataFrames (and plain parameters) and returns DataFrames;
``schema.py`` states the table contracts they expect.
"""
