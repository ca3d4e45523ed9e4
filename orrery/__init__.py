"""orrery: evidence retrieval and corpus processing on Spark DataFrames.

The package is declared on the DataFrame and SQL API; Python code runs inside Arrow batches only where no built-in
expression has the semantics. Subpackages:

``functions``  column expressions and pure text rules
``operators``  DataFrame to DataFrame operators of retrieval, ranking, planning and evaluation
``sources``    readers and writers of filings, golden sets, run files and chat history
``plans``      registered queries and the SQL each is checked against
``streaming``  incremental ingest
"""
