"""Report, audit and table-maintenance operators for a distribution business, on Spark DataFrames."""
