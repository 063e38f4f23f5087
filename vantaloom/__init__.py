"""vantaloom: a Spark-first engine for retrieval analytics.

Every operator takes and returns DataFrames and leaves the physical plan to
Catalyst. Subpackages: ``sources`` (readers, sinks, staging), ``functions``
(column expressions), ``operators`` (DataFrame transformations), ``plans``
(the registered queries and their SQL twins), ``streaming`` (stateful twins of
the time-dependent operators).
"""

__version__ = "0.1.0"
