"""bytelake: byte-level corpus, reward-data and evaluation operators on Spark DataFrames.

Every public operator is a plain ``DataFrame -> DataFrame`` function (no action inside,
no global state); randomness is keyed on row keys so results do not depend on partitioning.
"""

__version__ = "0.1.0"
