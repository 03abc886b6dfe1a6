"""Spark-first data engine for image and video annotation data.

Layers: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (dataset formats), ``plans`` (queries over the test
tables with their SQL twins), ``streaming`` (keyed state).  The optional
subpackage ``llm`` holds the operators for training text; nothing outside it
imports it.
"""

__version__ = "0.1.0"
