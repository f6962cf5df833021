"""feedlake: Spark-native analytics over rated free-text records.

Every operator takes and returns a Spark DataFrame.  Sub-packages:

- ``sources``   readers, writers, role resolution, history / embedding tables
- ``functions`` scalar Column expressions (normalisation, hashing, periods, vectors)
- ``operators`` relational building blocks (filters, profiles, trends, kNN, clusters)
- ``plans``     compositions that answer the analysis questions, and the query registry
- ``streaming`` incremental ingest of arriving files
"""

__version__ = "0.1.0"
