"""Climate-peril analytics as Spark jobs.

Every public function takes DataFrames (plus plain parameters such as dates)
and returns a DataFrame.  Nothing here runs an action unless its docstring
says so, nothing uses a Python UDF, and clock values (``now``, ``today``) are
always arguments.  Sessions are expected to run in UTC.
"""
