"""pursewise: public spending analytics as Spark jobs.

Modules: ``operators`` (filters, periods, facts, heads, tree, joins, shaping, extract),
``plans`` (request planning), ``sources`` (tables, captured-response fixtures, CSV/JDBC
IO), ``streaming`` (file-drop ingest), ``functions`` (Column builders), ``endpoints`` (one
function per request of the reference) and ``registry`` (the registered queries).
"""

__version__ = "0.1.0"
