"""Spark-native triage and evaluation of record-linkage candidate pairs.

Every operator takes DataFrames and parameters and returns a DataFrame; nothing here keeps
rows on the driver.  Sub-packages:

- ``functions``: column expressions (lenient parsing, rates, intervals, text similarity)
- ``operators``: DataFrame operators (bands, calibration, triage, metrics, splits, drift, ...)
- ``sources``: scans and sinks
- ``plans``: end-to-end pipelines and the catalogue of registered queries
- ``streaming``: the triage pipeline over a stream
"""

__version__ = "0.1.0"
