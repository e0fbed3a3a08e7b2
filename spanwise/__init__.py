"""spanwise: exposure, overlap and evidence analytics for text corpora on PySpark."""

__version__ = "0.1.0"
