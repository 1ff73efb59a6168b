"""peerlens: DataFrame operators for peer-observed transaction announcements.

The package is split by role:

* ``sources``    readers and writers (captures, vendor lists, parquet, lineage)
* ``functions``  column expressions without state
* ``operators``  DataFrame -> DataFrame operators
* ``plans``      named queries over a directory of tables, with their SQL twins
* ``streaming``  Structured Streaming forms of the intake operators
* ``llm``        operators for text corpora; nothing else imports it
"""

__version__ = "0.1.0"
