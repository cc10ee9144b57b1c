"""Data-product contracts, access plans and definition plans as Spark jobs.

Every public function takes and returns DataFrames (or Columns) and works on a
whole estate at once.  Problems are rows or columns of the result, never
exceptions raised while a job runs.
"""

__version__ = "0.1.0"
