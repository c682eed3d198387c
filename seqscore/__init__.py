"""seqscore: Spark-native scoring, clustering and reporting for libraries of short DNA sequences.

Every operator takes DataFrames and returns DataFrames. Sub-packages:

- ``sources``    readers, writers and the test fixtures derived from the driver tables
- ``functions``  column expressions (GC content, k-mers, complements, id parsing)
                 and the small NumPy helpers used inside pandas UDFs
- ``operators``  relational, statistical, similarity, motif, metric and ML operators
- ``plans``      the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
