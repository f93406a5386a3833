"""skarv: a PySpark-native engine for company evidence and text corpora.

Every operator takes and returns DataFrames, declares its plan with the
DataFrame API and leaves the physical strategy to Catalyst.
"""

__version__ = "0.1.0"
