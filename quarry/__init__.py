"""quarry: Spark-native operators for tick marts, file ingestion, data quality,
mart building, operations analytics, log replay and key-value reshaping.

Every operator is a ``DataFrame -> DataFrame`` function (or a Structured
Streaming job) built from Spark SQL expressions; see README.md.
"""

__version__ = "0.1.0"
