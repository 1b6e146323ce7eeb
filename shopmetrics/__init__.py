"""Retail analytics on Spark DataFrames.

Layers, lowest first:

* ``functions``  Column -> Column expressions; no DataFrame access.
* ``sources``    schemas, readers, typed imports, report sinks.
* ``operators``  reusable DataFrame steps: stock-taking joins, batch ledger jobs, tills.
* ``plans``      the reports a user calls; each returns a lazy DataFrame.

"""
