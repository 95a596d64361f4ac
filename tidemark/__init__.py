"""tidemark: schema-change analytics for fleets of databases, as Spark DataFrames.

Every data set carries a leading ``db_id``; every function takes and returns lazy
DataFrames or Columns.  Sessions should run with the UTC time zone.
"""
