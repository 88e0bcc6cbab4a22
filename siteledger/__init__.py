"""Construction-supervision analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) and only builds
a plan; nothing here pulls rows to the driver.
"""
