"""lagwell: Spark-native analytics for trajectories that hop between long-lived states.

Frames (rows of a time-ordered table) stay in DataFrames and are planned by
Catalyst; only state-by-state matrices, whose size does not depend on the
number of frames, are solved on the driver.
"""

__version__ = "0.1.0"
