"""closebook — month-end purchase accruals as Spark jobs.

Subpackages:
  sources    readers/writers, the test-data adapter, snapshots
  functions  scalar Column builders (text, periods, numbers, contracts)
  operators  rule compiler, lookups, aggregates, domain logic
  plans      composed monthly flows and the query registry
"""
