"""postlens: keyword search, text cleaning, two-scorer sentiment labelling and
agreement reports over discussion posts, written as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (compose with
``df.transform``); row-local operators work on batch and streaming frames.
"""

__version__ = "0.1.0"
