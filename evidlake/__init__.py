"""Evidence engine on Spark: counting, listing, retrieving and evaluating over evidence tables.

Packages: `functions` (column expressions), `operators` (DataFrame to DataFrame), `plans` (size checks
and plan assertions), `sources` (readers and writers), `streaming` (incremental jobs). Everything stays
lazy unless a docstring says that it runs a job.
"""
